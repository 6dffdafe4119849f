"""Multi-pattern search: every occurrence of every pattern, overlaps included, as rows.

Two ways with equal results. "split" joins texts with a broadcast pattern table on containment and finds the places by
splitting at look-ahead matches; it suits lists of up to a few hundred words. "anchor" is for longer ones: each pattern is filed
under one of its q-grams, each place of a text gives one q-gram, the two meet in a hash join, and the pattern is compared at
its place. ("shingle" and "trie" are former names of ways to search long lists; they now mean "anchor".)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ahead_of, places

#: A longer list is searched by anchors.
SPLIT_UP_TO = 300
#: Length of an anchor; a shorter pattern is its own.
GRAM = 3
#: A larger table of anchors is broadcast in pieces of this size, one after the other.
BROADCAST_BYTES = 32 << 20
#: Lists are bounded (Config.max_words); nothing longer is broadcast.
MOST_PATTERNS = 400_000


def _by_split(texts: DataFrame, col: str, patterns: DataFrame, kind: str | None) -> DataFrame:
    table = F.broadcast(patterns.withColumn("ahead", ahead_of(F.col("pattern"))))
    joined = texts.join(table, F.contains(F.col(col), F.col("pattern")) & _same(kind))
    return joined.withColumn("at", F.explode(places(F.col(col), F.col("pattern"), F.col("ahead")))).drop("ahead")


def grams(text: Column, width: int) -> Column:
    """The strings of `width` characters that begin at each place of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1))


def anchored(patterns: DataFrame) -> DataFrame:
    """patterns with _gram, one of their q-grams, and its place _back: the one that fewest patterns hold, so that no gram collects many patterns."""
    width = F.least(F.length("pattern"), F.lit(GRAM))
    mine = F.when(width == GRAM, grams(F.col("pattern"), GRAM)).otherwise(F.array("pattern"))
    named = patterns.select("pattern").distinct().select("pattern", F.posexplode(mine).alias("_back", "_gram"))
    often = named.groupBy("_gram").agg(F.count_distinct("pattern").alias("_often"))
    best = named.join(often, "_gram").groupBy("pattern").agg(F.min(F.struct("_often", "_gram", "_back")).alias("_a"))
    return patterns.join(best.select("pattern", "_a._gram", "_a._back"), "pattern")


def _by_anchor(texts: DataFrame, col: str, patterns: DataFrame, kind: str | None) -> DataFrame:
    """A text's places are rows only within the join's stage: they carry a reference to the text, and those that meet no anchor go no further."""
    table = anchored(patterns)
    size, shortest = patterns.agg(F.coalesce(F.sum(3 * F.octet_length("pattern") + 100), F.lit(0)), F.coalesce(F.min(F.length("pattern")), F.lit(GRAM))).first()
    pieces = max(1, -(-size // BROADCAST_BYTES))
    parts = []
    for width in range(min(shortest, GRAM), GRAM + 1):
        at_places = texts.select("*", F.posexplode(grams(F.col(col), width)).alias("_place", "_gram"))
        for k in range(pieces):
            some = table.where(F.length("_gram") == width)
            some = some.where(F.pmod(F.xxhash64("pattern"), F.lit(pieces)) == k) if pieces > 1 else some
            met = at_places.join(F.broadcast(some), (at_places["_gram"] == some["_gram"]) & _same(kind)).drop("_gram")
            at = F.col("_place") - F.col("_back")
            whole = (at >= 0) & (F.substring(F.col(col), at + 1, F.length("pattern")) == F.col("pattern"))
            parts.append(met.where(whole).withColumn("at", at).select(*texts.columns, *patterns.columns, "at"))
    return reduce(DataFrame.unionByName, parts)


def _same(kind: str | None):
    return F.col(kind) == F.col("pattern_kind") if kind else F.lit(True)


def bounded(patterns: DataFrame) -> DataFrame:
    """patterns, if they are few enough to be broadcast."""
    if patterns.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    return patterns


def find_all(texts: DataFrame, col: str, patterns: DataFrame, variant: str = "auto", kind: str | None = None) -> DataFrame:
    """texts joined with patterns (pattern, ...) at each occurrence of a pattern in col; ``at`` is its start from 0.

    kind: a column of texts; each text then only meets the patterns whose pattern_kind is equal. Patterns must not be empty; null texts match nothing. A pattern table of over MOST_PATTERNS rows is refused.
    """
    if variant == "auto":
        count = bounded(patterns).limit(SPLIT_UP_TO + 1).count()
        variant = "split" if count <= SPLIT_UP_TO else "anchor"
    return {"split": _by_split, "anchor": _by_anchor, "shingle": _by_anchor, "trie": _by_anchor}[variant](texts, col, patterns, kind)


def has_match(texts: DataFrame, col: str, patterns: DataFrame) -> DataFrame:
    """The rows of texts whose col holds a pattern."""
    return texts.join(F.broadcast(bounded(patterns.select("pattern").distinct())), F.contains(F.col(col), F.col("pattern")), "left_semi")
