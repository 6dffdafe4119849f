"""Scores, severity tiers, actions and message summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Tier

# What a method adds to a word's base score; fuzzy adds its step for each unit of distance.
PENALTIES = {"exact": 0.0, "separator_bypass": 0.2, "leetspeak": 0.2, "homoglyph": 0.1, "repetition": 0.15}
FUZZY_STEP = 0.05
MOST_BOOST = 1.5


def penalty(method: Column, distance: Column) -> Column:
    out = F.when(method == "fuzzy", F.lit(FUZZY_STEP) * F.coalesce(F.nullif(distance, F.lit(0)), F.lit(1)))
    for name, value in PENALTIES.items():
        out = out.when(method == name, F.lit(value))
    return out.otherwise(F.lit(0.0))


def final_score(base: Column, method: Column, distance: Column, word_count: Column, distinct: Column) -> Column:
    """min(1, min(1, base + penalty) * boost); the boost grows with the share of distinct words among all, to 1.5 at most."""
    boost = F.when(word_count > 0, F.least(F.lit(MOST_BOOST), F.lit(1.0) + distinct / F.greatest(F.lit(1), word_count))).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), F.least(F.lit(1.0), base + penalty(method, distance)) * boost)


def _highest_reached(score: Column, tiers: tuple[Tier, ...], attribute: str, other: str) -> Column:
    out = F.lit(other)
    for tier in tiers:
        out = F.when(score >= tier.threshold, F.lit(getattr(tier, attribute))).otherwise(out)
    return out


def tier_of(score: Column, tiers: tuple[Tier, ...]) -> Column:
    return F.when(score >= 1.0, F.lit("critical")).otherwise(_highest_reached(score, tiers, "label", "low"))


def action_of(score: Column, tiers: tuple[Tier, ...]) -> Column:
    return _highest_reached(score, tiers, "action", "log")


def scored(detections: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """detections (keys, word, base_score, method, distance, word_count, ...) with final_score and tier."""
    distinct = F.size(F.collect_set(F.lower("word")).over(Window.partitionBy(*keys)))
    out = detections.withColumn("distinct_words", distinct)
    score = final_score(F.col("base_score"), F.col("method"), F.col("distance"), F.col("word_count"), F.col("distinct_words"))
    return out.withColumn("final_score", score).withColumn("tier", tier_of(F.col("final_score"), config.severities))


def summary_of(detections: str, config: Config) -> Column:
    """Summary struct of an array of scored detections."""
    scores = F.transform(detections, lambda d: d["final_score"])
    count = F.size(detections)
    highest = F.coalesce(F.array_max(scores), F.lit(0.0))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        count.alias("total_detections"),
        F.size(F.array_distinct(F.transform(detections, lambda d: F.lower(d["word"])))).alias("distinct_words"),
        highest.alias("highest_score"),
        F.when(count > 0, F.round(total / count, 4)).otherwise(F.lit(0.0)).alias("average_score"),
        F.when(count > 0, tier_of(highest, config.severities)).otherwise(F.lit("low")).alias("tier"),
        F.when(count > 0, action_of(highest, config.severities)).otherwise(F.lit("log")).alias("action"),
    )
