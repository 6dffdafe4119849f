"""The full scan: messages and a word list in, detections and one report a message out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as tx
from ..functions.cached import built_once
from ..operators import fuzzy, rowwise, score, stages, wordlist
from ..operators.match import SPLIT_UP_TO
from ..sources.lexicon import Lexicon

KEYS = stages.KEYS
#: What a message may bring besides its text; options overrides the configuration, the others come out in its report.
CARRIED = ("timestamp", "context")


def prepared(messages: DataFrame, config: Config, id_col: str = "message_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """(message_id, text_key, text, n, n_length, word_count[, options, timestamp, context]): truncated, normalised texts.

    Rows of one id and text are one message; unique says that there are none, which saves shuffling the texts. A null or empty id becomes a hash of the text; a null text is empty.
    """
    text = tx.truncate(F.coalesce(F.col(text_col), F.lit("")), config.max_message_length)
    more = [c for c in ("options", *CARRIED) if c in messages.columns and c not in (id_col, text_col)]
    rows = messages.select(F.col(id_col).cast("string").alias("message_id"), text.alias("text"), *more)
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    rows = rows.withColumn("message_id", F.coalesce(F.nullif("message_id", F.lit("")), F.concat(F.lit("m-"), F.sha1("text"))))
    rows = rows if unique else rows.dropDuplicates(KEYS)
    rows = rows.withColumn("n", tx.normalize(F.col("text"), config.case_sensitive))
    return rows.select(*KEYS, "text", "n", F.greatest(F.length("n"), F.lit(1)).alias("n_length"), tx.word_count(F.col("text")).alias("word_count"), *more)


@dataclass(frozen=True)
class ScanResult:
    """Lazy tables. What both are made from is kept on first use (keep); release() frees it."""

    detections: DataFrame
    reports: DataFrame
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


@built_once
def _scored(with_tags: bool, config: Config) -> Column:
    """The column found as an array of scored detections, by stage, end, start and word."""
    method = F.create_map(*(F.lit(x) for k, v in stages.METHOD.items() for x in (k, v)))
    none = F.array().cast("array<string>")
    tags_of = lambda word: F.coalesce(F.try_element_at("list.tags", word), F.try_element_at("lengths.tags", word), none)

    def each(d: Column, distinct: Column) -> Column:
        def made(x: Column) -> Column:
            columns = {"word": d["word"], "matched_form": d["matched_form"], "start": d["start"], "end": d["end"], "base_score": d["base_score"], "final_score": x["score"], "method": x["method"]}
            columns |= {"sub_methods": F.when(x["method"] == "exact", none).otherwise(F.array(x["method"])), "homoglyphs_detected": d["homoglyphs_detected"], "distance": d["distance"]}
            columns |= {"tags": tags_of(d["word"]) if with_tags else none, "tier": score.tier_of(x["score"], config.severities)}
            return F.struct(*(v.alias(k) for k, v in columns.items()))

        named = F.element_at(method, d["ord"])
        return tx.once(F.struct(named.alias("method"), score.final_score(d["base_score"], named, d["distance"], F.col("word_count"), distinct).alias("score")), made)

    distinct = F.size(F.array_distinct(F.transform("found", lambda d: F.lower(d["word"]))))
    return tx.once(distinct, lambda n: F.transform(F.array_sort("found"), lambda d: each(d, n)))


@built_once
def _summary(config: Config) -> Column:
    return score.summary_of("detections", config)


def scan(messages: DataFrame, lexicon: Lexicon, config: Config | None = None, *, id_col: str = "message_id", text_col: str = "text", variant: str = "auto", with_tags: bool = False, keep: bool = True, unique: bool = False) -> ScanResult:
    """Find the words of the list, plain and disguised, in every message.

    detections: one row each, scored; reports: one row a message with its detections (by stage, end, start, word), summary
    and action, and the message's timestamp and context if it has them. Each message is scanned within its row. A list of up
    to SPLIT_UP_TO enabled words lies beside every message, without a join by key or a shuffle ("rows"). Of a longer one, of
    at most Config.max_words words, each message first gets the words that an anchor search finds in any reading of it
    ("anchor"). variant names a way. An empty list or message gives reports without detections.
    """
    config = config or Config()
    words = lexicon.patterns()
    most = config.max_words
    if variant in ("auto", "rows"):
        head = words.limit((SPLIT_UP_TO if variant == "auto" else most) + 1).collect()
        variant = "rows" if variant == "rows" or len(head) <= SPLIT_UP_TO else "anchor"
    over = len(head) > most if variant == "rows" else words.limit(most + 1).count() > most
    if over:
        raise ValueError(f"more than {most} words")
    ready = prepared(messages, config, id_col, text_col, unique)
    kept: list[DataFrame] = []

    def keeping(df: DataFrame) -> DataFrame:
        if keep:
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    if variant == "rows":
        rows = ready.crossJoin(F.broadcast(wordlist.shared(ready.sparkSession, head, config)))
    else:
        rows = wordlist.with_candidates(keeping(ready), words, config, KEYS, variant, with_tags)
    rows = rowwise.detected(rows, config)
    if config.fuzzy.max_checks == 0:
        rows = fuzzy.with_indexed(rows, words, config)
    carried = [c for c in CARRIED if c in ready.columns]
    rows = rows.select("message_id", *carried, "text", F.col("n").alias("normalized_text"), "word_count", _scored(with_tags, config).alias("detections"))
    rows = keeping(rows)
    reports = rows.withColumn("summary", _summary(config))
    return ScanResult(rows.select("message_id", F.inline("detections")), reports, tuple(kept))
