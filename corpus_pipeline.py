"""The corpus pipeline: raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordshield.llm import decontamination, near_dedup, quality_classifier, queries, suffix_dedup
from wordshield.llm.common import drop_written, text_keys, written


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, id, t0, t1): each document whole, so that none of its columns can clash, with its text's key; a null text counts as empty."""
    keys = text_keys(F.coalesce("text", F.lit("")))
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), *(v.alias(k) for k, v in keys.items()))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep_good(docs, queries.quality_model(spark, docs, sf_dir), queries.QUALITY_THRESHOLD)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (its smallest doc_id); of equal rows one stays."""
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("id").alias("kept_id"), F.col("t0").alias("kept_t0"), F.col("t1").alias("kept_t1")).distinct()
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("t0") == F.col("kept_t0")) & (F.col("t1") == F.col("kept_t1"))
    return _keyed(docs).join(kept, same, "left_semi").dropDuplicates(["id", "t0", "t1"]).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte strings; characters that a cut splits go too."""
    out = suffix_dedup.remove_repeats(docs, carry=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too large a share of benchmark passages."""
    found = decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))
    dirty = found.where("contaminated").select("t0", "t1").distinct()
    return _keyed(docs).join(dirty, ["t0", "t1"], "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens placed in sequences of 1024."""
    return queries.packed_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("near_dedup", deduplicate),
    ("suffix_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: The classifier and the packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; each stage's output is written, and goes when the next one's is there."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
