"""Queries of the readers, the word list and the report log, with their DuckDB equivalents; files are written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Leetspeak, Repetition, Stage
from ..functions import chars
from ..functions import text as tx
from ..operators import rowwise, stages
from ..operators.match import find_all
from ..schemas import DETECTION
from ..sources import lexicon as lx
from ..sources import messages as ms
from . import registry as rg
from . import reports as rp
from .registry import query, table
from .scan import prepared, scan


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{folder}/{uuid.uuid4().hex}-{name}"


def lines_of(spark: SparkSession, sf_dir: str, line, name: str, *around: tuple[int, str]) -> str:
    """Path of a text with a line for each row of part, in order; around: lines before (-1) or after (1) them, which makes it one document in one file."""
    rows = table(spark, sf_dir, "part").select(F.lit(0).alias("at"), "p_partkey", line.alias("value"))
    for at, text in around:
        rows = rows.union(spark.range(1).select(F.lit(at), F.lit(0).cast("long"), F.lit(text)))
    path = scratch(spark, name)
    ordered = rows.orderBy("at", "p_partkey").select("value")
    (ordered.coalesce(1) if around else ordered).write.text(path)
    return path


# --- readers


@query("select p_name as word, 0.5::double as base_score from part")
def read_txt_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lines_of(spark, sf_dir, F.concat(F.lit("  "), F.col("p_name"), F.lit("\n\n# "), F.col("p_brand")), "list.txt")
    return lx.read_txt(spark, path).select("word", "base_score")


@query("select p_brand as word, true as enabled from part")
def read_upload_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.read_upload(spark, lines_of(spark, sf_dir, F.col("p_brand"), "upload.lst")).select("word", "enabled")


@query("select p_name as word, p_retailprice as base_score, '[' || lower(p_brand) || ']' as tags, p_size > 20 as enabled from part")
def read_upload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.to_json(F.struct(F.col("p_name").alias("word"), F.col("p_retailprice").alias("base_score"), F.array(F.lower("p_brand")).alias("tags"), (F.col("p_size") > 20).alias("enabled")))
    path = lines_of(spark, sf_dir, F.concat(F.lit(", "), row), "upload.json", (-1, '[{"word": ""}'), (1, "]"))
    return lx.read_upload(spark, path).select("word", "base_score", F.concat(F.lit("["), F.array_join("tags", ","), F.lit("]")).alias("tags"), "enabled")


@query("select p_name as word, p_retailprice as base_score, p_brand || '|' || p_type as tags from part")
def read_upload_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "upload.csv")
    table(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.col("p_retailprice").alias("base_score"), F.concat("p_brand", F.lit(", ,"), "p_type").alias("tags")).write.csv(path, header=True)
    return lx.read_upload(spark, path).select("word", "base_score", F.array_join("tags", "|").alias("tags"))


@query("select distinct p_brand as word, 0.75::double as base_score from part")
def body_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = [r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().collect()]  # what a request's body would hold
    return lx.from_rows(spark, [{"word": b, "base_score": 0.75} for b in brands]).select("word", "base_score")


@query("select event_type as text, count(*) as n from events group by 1")
def csv_first_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "first.csv")
    table(spark, sf_dir, "events").select("event_type", "value").write.csv(path, header=True)
    return ms.read_first_column(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("select conv_id::varchar as message_id, text from conversations")
def message_source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "messages.json")
    table(spark, sf_dir, "conversations").select("conv_id", "text", "role").write.json(path)
    return ms.read_messages(spark, path, "json", "conv_id").select("message_id", "text")


@query("select conv_id::varchar as message_id, role as user, case when turn % 2 = 0 then 'homoglyph' else 'exact' end as method, count(*) as n from (select *, unnest(list_filter(range(0, length(text) - 2), lambda i: substr(lower(text), i::int + 1, 3) = 'the')) as at from conversations) group by 1, 2, 3")
def message_source_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options and context come with the messages: the look-alike stage is on where the turn is even and the text disguised."""
    path = scratch(spark, "messages.json")
    even = F.col("turn") % 2 == 0
    text = F.when(even, F.replace(F.lower("text"), F.lit("the"), F.lit("thе"))).otherwise(F.lower("text"))  # a Cyrillic letter
    table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("message_id"), text.alias("text"), F.struct(even.alias("homoglyph"), F.lit(False).alias("fuzzy")).alias("options"), F.create_map(F.lit("user"), F.col("role")).alias("context")).write.json(path)
    read = ms.read_messages(spark, path, "json", carried=("options", "context"))
    quiet = Config(leetspeak=Leetspeak(False), separator_bypass=Stage(False), repetition=Repetition(False), homoglyph=Stage(False))
    reports = scan(read, lx.Lexicon.of(spark, ["the"]), quiet, keep=False).reports
    found = reports.select("message_id", F.col("context")["user"].alias("user"), F.explode("detections").alias("d"))
    return found.groupBy("message_id", "user", F.col("d.method").alias("method")).agg(F.count("*").alias("n"))


@query("select 'm-' || sha1(text) as message_id, count(*) as n from (select distinct substr(text, 1, 10000) as text from conversations) group by 1")
def default_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    unnamed = table(spark, sf_dir, "conversations").select(F.lit("").alias("message_id"), "text")
    return prepared(unnamed, rg.CONFIG).groupBy("message_id").agg(F.count("*").alias("n"))


@query("select message_id, case when length(text) > 600 then 'over 600 characters' when text = '' then 'empty text' else '' end as error from (select conv_id::varchar || '-' || turn::varchar as message_id, text from conversations)")
def batch_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = ms.checked(rg.conversations(spark, sf_dir), 600)
    return good.select("message_id", F.lit("").alias("error")).union(bad)


@query("with r as (select conv_id::varchar || '-' || turn::varchar as message_id, text from conversations) select message_id, text from r")
def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ms.responses(rg.conversations(spark, sf_dir))
    return made.select("message_id", F.get_json_object("response", "$.text").alias("text"))


_TABLE = ", ".join(f"({rg.sql_str(a)}, {rg.sql_str(b)})" for a, b in chars.HOMOGLYPHS.items())


@query(f"with c as (select unnest(string_split(lower(text), '')) as seen from documents) select seen, read_as, count(*) as times from c join (values {_TABLE}) l(seen, read_as) using (seen) group by 1, 2")
def homoglyph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-alikes that the documents hold, what they are read as, and how often they occur."""
    seen = table(spark, sf_dir, "documents").select(F.explode(tx.chars(F.lower("text"))).alias("seen")).groupBy("seen").agg(F.count("*").alias("times"))
    return seen.select("seen", tx.replace_homoglyphs(F.col("seen")).alias("read_as"), "times").where("seen <> read_as")


# --- word list

_LISTED = "o as (select lower(p_name) as k, min(p_partkey) as first, arg_min(p_name, p_partkey) as word, arg_max(p_retailprice, p_partkey) as base_score, arg_max(p_size > 20, p_partkey) as enabled from part group by 1), l as (select *, row_number() over (order by first) as ord from o)"


def listed(spark: SparkSession, sf_dir: str) -> lx.Lexicon:
    """The part names as a word list, enabled by size."""
    rows = rg.part_words(spark, sf_dir, "true").drop("enabled").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), (F.col("p_size") > 20).alias("enabled")), "ord")
    return lx.Lexicon.empty(spark).add_many(rows)


@query(f"with {_LISTED} select word, base_score, enabled, ord as id, ord from l")
def lexicon_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved and loaded again: ids, order and switches stay."""
    path = scratch(spark, "words")
    listed(spark, sf_dir).save(path)
    return lx.Lexicon.load(spark, path, fill=False).entries.select("word", "base_score", "enabled", "id", "ord")


@query(f"with {_LISTED} select word, base_score from l where k = (select max(k) from l)")
def lexicon_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = listed(spark, sf_dir)
    last = words.entries.agg(F.max(lx.key(F.col("word")))).first()[0]
    return words.get(f" {last.upper()} ").select("word", "base_score")


@query(f"with {_LISTED} select word, ord from l where enabled")
def lexicon_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).enabled().select("word", "ord")


@query(f"with {_LISTED} select lower(word) as word, base_score from l where enabled")
def lexicon_word_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).word_map()


@query(f"with {_LISTED} select count(*) as words, 0::bigint as cleared from l")
def lexicon_count_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = listed(spark, sf_dir)
    return words.entries.agg(F.count("*").alias("words")).join(words.clear().entries.agg(F.count("*").alias("cleared")))


# --- report log


def stored_reports(spark: SparkSession, sf_dir: str, form: str, by_type: bool = False, shards: int = 0) -> rp.ReportTable:
    """A log of one report for each event, appended in one go, in the order of their times."""
    pieces = rp.pieces_of(table(spark, sf_dir, "events").count())
    rows = rg.event_reports(spark, sf_dir).repartitionByRange(pieces, "timestamp", "message_id").sortWithinPartitions("timestamp", "message_id")
    found = F.from_json(F.to_json(F.col("detections")), f"array<{DETECTION.simpleString()}>")
    ids = F.col("detections")[0]["word"] if by_type else F.col("message_id")
    log = rp.ReportTable(spark, scratch(spark, "log"), form=form, shards=shards)
    log.append(rows.withColumns({"message_id": ids, "detections": found, "text": F.lit("text"), "normalized_text": F.lit("text"), "context": F.create_map(F.lit("k"), F.lit("v"))}), pieces=pieces)
    return log


@query(f"{rg._REPORTS} select message_id, tier, action, timestamp::date as day, word, '{{\"k\":\"v\"}}' as context from q")
def report_append_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_reports(spark, sf_dir, "json").all()
    return rows.select("message_id", "summary.tier", "summary.action", "day", F.col("detections")[0]["word"].alias("word"), "context")


@query(f"{rg._REPORTS} select word as message_id, max(timestamp) as timestamp from q group by 1")
def report_save_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rp.current(stored_reports(spark, sf_dir, "parquet", by_type=True).all())
    return rows.select("message_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query(f"{rg._REPORTS} select message_id, s as highest from q order by timestamp desc, message_id limit 10000")
def report_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "export")
    stored_reports(spark, sf_dir, "parquet").export(path)
    return spark.read.json(path).select("message_id", F.col("summary.highest_score").alias("highest"))


@query(f"{rg._REPORTS}, t as (select count(*) as total from q where tier = 'medium') select message_id, total from (select * from q where tier = 'medium' order by timestamp, message_id limit 30 offset 30), t")
def report_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total = stored_reports(spark, sf_dir, "parquet").page(2, 30, "medium")
    return rows.select("message_id", F.lit(total).cast("long").alias("total"))


@query(f"{rg._REPORTS} select word, n from (select word, count(*) as n, min((timestamp, message_id)) as first from q group by 1) order by n desc, first limit 3")
def top_words_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.top_words(rg.event_reports(spark, sf_dir), 3, first_seen=True)


# --- stages


@query(f"with {rg.sql_messages(*rg._MIXED)}, {rg._FOUND}, {rg._COVER}, {rg._KEPT} select message_id, word, ord, start, \"end\" from r")
def dedup_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection twice: one of each stays."""
    messages = rg.conversations(spark, sf_dir, *rg._MIXED)
    pieces = stages.pieces_of(messages.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    ready = prepared(messages, rg.CONFIG)
    seen = stages.views(ready, rg.CONFIG).where("ord <= 3")
    found = stages.located(find_all(seen, "view", stages.patterns_of(rg.words(spark), rg.CONFIG), kind="kind"), rg.CONFIG, pieces)
    return stages.resolved(found.union(found), pieces).select("message_id", "word", "ord", "start", "end")


_PAIRS = f"array_to_string(list_transform(list_filter(string_split(n, ''), lambda c: c <> '' and contains('{chars.HOMOGLYPH_FROM}', c) and contains(substr(n, p::int + 1, length(word)), c)), lambda c: c || '>' || translate(c, '{chars.HOMOGLYPH_FROM}', '{chars.HOMOGLYPH_TO}')), ' ')"


@query(f"with {rg.sql_messages(*rg._ALIKE)}, h as (select *, {rg._LOOK} as v from m where {rg._LOOK} <> n) select message_id, word, p::int as start, {_PAIRS} as pairs from (select *, unnest({rg.sql_places('v', 'word')}) as p from h, w where contains(v, word))")
def homoglyph_detection_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rg.stage(spark, rg.conversations(spark, sf_dir, *rg._ALIKE), 3)
    return found.select("message_id", "word", "start", F.array_join(F.transform("homoglyphs_detected", lambda p: F.concat_ws(">", p)), " ").alias("pairs"))


@query(rg._RUNS.replace("l as (select message_id, n,", f"k as (select message_id, {rg._CLEAN} as n from m where {rg._CLEAN} <> n),\nl as (select message_id, n,").replace("as p1 from m)", "as p1 from k)"))
def combined_repetition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.stage(spark, rg.conversations(spark, sf_dir, *rg._STRETCHED), 8).select("message_id", "word", "start", "end", "matched_form")


_OPEN = rg._TOKENS.replace("where length(t.piece) >= 4)", "where length(t.piece) >= 4 and not exists (select 1 from w where contains(n, word) and word = t.piece))").replace("from (select message_id, unnest", "from (select message_id, n, unnest")


@query(f"with {rg.sql_messages(*rg._EDITED)}, {_OPEN}, {rg._BUDGET}, {rg._NEAREST} select message_id, word, token as matched_form, start, distance::int as distance from d where nth = 1")
def fuzzy_skips_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are themselves words found in the message take no part, nor count against the budget."""
    ready = prepared(rg.conversations(spark, sf_dir, *rg._EDITED), rg.CONFIG, unique=True)
    rows = rg.with_list(ready).withColumns({"found": rowwise.stage_column(2, rg.CONFIG), "covered": F.lit(False)})
    found = rowwise.with_fuzzy(rows, rg.CONFIG).select("message_id", F.inline("found")).where("ord = 9")
    return found.select("message_id", "word", "matched_form", "start", "distance")
