"""Queries over long word lists and over changes of a list, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..config import Fuzzy
from ..operators.fuzzy import near_pairs
from ..operators.match import find_all
from ..sources import lexicon as lx
from . import registry as rg
from .registry import query, table
from .registry_store import scratch
from .rescan import rescan
from .scan import scan

#: The words of the benchmark's texts: over a thousand in the tables, more than a list beside every message may have.
_LONG = "select word, 0.25::double as base_score, row_number() over (order by word) as ord from (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark) where length(word) >= 4"


def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(tx.runs_of(F.lower("text"), "a-z")).alias("word"))
    return words.where(F.length("word") >= 4).distinct()


def long_lexicon(spark: SparkSession, sf_dir: str) -> lx.Lexicon:
    """The words as a list in use. Their hashes serve as places in it, as nothing here depends on them."""
    rows = long_words(spark, sf_dir).select("word", F.lit(0.25).alias("base_score"), F.array().cast("array<string>").alias("tags"), F.lit(True).alias("enabled"), F.crc32("word").alias("ord"))
    return lx.Lexicon(lx._entries(rows))


@query(f"with {rg.sql_messages(w=_LONG)} select message_id, word, unnest({rg.sql_places('n', 'word')})::int as start from m, w where contains(n, word)")
def long_list_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every word, by the anchor index."""
    texts = rg.conversations(spark, sf_dir).select("message_id", F.lower("text").alias("n"))
    found = find_all(texts, "n", long_words(spark, sf_dir).withColumnRenamed("word", "pattern"), "anchor")
    return found.select("message_id", F.col("pattern").alias("word"), F.col("at").alias("start"))


@query(f"with {rg.sql_messages(w=_LONG)}, t as (select distinct unnest(regexp_extract_all(n, '[a-z0-9]+')) as token from m) select token, word, levenshtein(token, word)::int as distance from t, w where length(token) >= 4 and abs(length(token) - length(word)) <= 2 and levenshtein(token, word) <= 2 and levenshtein(token, word) / length(word) <= 0.25")
def fuzzy_index_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens near any of a long list's words, by the index of deletions: no budget, and no comparison of all with all."""
    tokens = rg.conversations(spark, sf_dir).select(F.explode(tx.runs_of(F.lower("text"), "a-z0-9")).alias("token")).where(F.length("token") >= 4)
    return near_pairs(tokens, long_words(spark, sf_dir), Fuzzy()).select("token", "word", "distance")


def _summary_sql(w: str, *disguise: tuple[str, str]) -> str:
    """The reports of the first two stages, by list w."""
    return f"""with {rg.sql_messages(*disguise, w=w)}, {rg._FOUND}, {rg._COVER}, {rg._KEPT}, {rg._COUNTS}, {rg._SCORED},
g as (select message_id, count(*)::int as total_detections, count(distinct word)::int as distinct_words, max(final_score) as highest from s group by message_id)
select message_id, coalesce(total_detections, 0)::int as total_detections, coalesce(distinct_words, 0)::int as distinct_words, round(coalesce(highest, 0), 9) as highest, {rg._TIER.format(x='coalesce(highest, 0)')} as tier, {rg._ACTION.format(x='coalesce(highest, 0)')} as action from m left join g using (message_id)"""


def _summaries(reports: DataFrame) -> DataFrame:
    return reports.select("message_id", "summary.total_detections", "summary.distinct_words", F.round("summary.highest_score", 9).alias("highest"), "summary.tier", "summary.action")


@query(_summary_sql(_LONG, *rg._MIXED))
def long_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default way of a long list: each message gets the words that the anchor index finds in it, and is scanned within its row."""
    return _summaries(scan(rg.conversations(spark, sf_dir, *rg._MIXED), long_lexicon(spark, sf_dir), rg.PLAIN, unique=True, keep=False).reports)


def _changed(spark: SparkSession) -> tuple[lx.Lexicon, lx.Lexicon]:
    old = rg.word_list(spark)
    new = old.delete(["nicht", "ver"]).update("para", base_score=0.2).update("eau", enabled=False)
    return old, new.add_many(lx.from_rows(spark, [{"word": "Ning", "base_score": 0.65}, {"word": "THING", "base_score": 0.95}]))


_NEW_LIST = ", ".join(f"({rg.sql_str(w)}, {s}::double, {k})" for k, (w, s) in enumerate([("the", 0.3), ("thing", 0.95), ("tion", 0.4), ("ent", 0.35), ("para", 0.2), ("erth", 0.55), ("anan", 0.45), ("ning", 0.65)]))


@query(_summary_sql(f"values {_NEW_LIST}", *rg._MIXED))
def rescan_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words added, deleted, switched off and given another score: only messages that hold one are scanned again."""
    messages = rg.conversations(spark, sf_dir, *rg._MIXED)
    old, new = _changed(spark)
    stored = scratch(spark, "reports")  # a log's reports are there when its list changes; each step below reads them
    made = scan(messages, old, rg.PLAIN, unique=True, keep=False).reports
    made.write.parquet(stored)
    before = spark.read.schema(made.schema).parquet(stored)
    return _summaries(rescan(messages, before, old, new, rg.PLAIN, unique=True).reports)


@query(f"with o(word, base_score) as (values ('the', 0.3::double), ('thing', 0.95), ('tion', 0.4), ('ent', 0.35), ('eau', 0.7), ('para', 0.2), ('erth', 0.55), ('anan', 0.45), ('ning', 0.65)), {rg.sql_messages()} select o.word, base_score, count(message_id) as messages from o left join m on contains(n, o.word) group by 1, 2")
def lexicon_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list after changes of all kinds, and how many messages hold each entry."""
    _, new = _changed(spark)
    words = new.entries.select(F.lower("word").alias("word"), "base_score")
    texts = rg.conversations(spark, sf_dir).select("message_id", F.lower("text").alias("n"))
    held = texts.join(F.broadcast(words), F.contains("n", "word")).groupBy("word").agg(F.count("*").alias("messages"))
    return words.join(held, "word", "left").select("word", "base_score", F.coalesce("messages", F.lit(0)).alias("messages"))
