"""The plain rule path: words found in a text's letters and digits alone, with a verdict and highlighting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .match import bounded


def rule_detect(messages: DataFrame, words: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """(id, words, score, hits) for every message; words (word, ord) that occur in its reduced form, in list order."""
    listed = bounded(words.select("word", "ord", tx.rule_form(F.col("word")).alias("form")).where("form <> ''"))
    reduced = messages.select(F.col(id_col).alias("id"), F.coalesce(tx.rule_form(F.col(text_col)), F.lit("")).alias("reduced"), F.monotonically_increasing_id().alias("row"))
    # the list is bounded, so each message meets it as one array and needs no shuffle
    lexicon = listed.agg(F.array_sort(F.collect_list(F.struct("ord", "word", "form"))).alias("lexicon"))
    found = F.transform(F.filter("lexicon", lambda w: F.contains(F.col("reduced"), w["form"])), lambda w: w["word"])
    out = reduced.join(F.broadcast(lexicon)).select("id", found.alias("words"))
    return out.select("id", "words", verdict(F.col("words")).alias("score"), F.size("words").alias("hits"))


def verdict(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.lit(100)).otherwise(F.lit(0))


def classify_rest(messages: DataFrame, ruled: DataFrame, classifier: Callable[[Column], Column] | None, text_col: str = "text", id_col: str = "message_id") -> DataFrame:
    """ruled with the answer of a column function (such as a pandas UDF over a model) for messages without rule hits; null without one."""
    joined = ruled.join(messages.select(F.col(id_col).alias("id"), text_col), "id")
    answer = classifier(F.col(text_col)) if classifier else F.lit(None).cast("string")
    return joined.withColumn("answer", F.when(F.col("hits") == 0, answer)).drop(text_col)
