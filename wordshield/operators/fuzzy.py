"""Fuzzy matching of whole tokens against the word list, under a budget of comparisons a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Fuzzy
from ..functions import text as tx
from ..functions.text import once
from .stages import FOUND, KEYS, SIZES


def distance_of(token: Column, word: Column, most: Column, kind: str = "edits") -> Column:
    """Edits between two strings, -1 if there are over `most`.

    kind "edits" is the Levenshtein distance; "doubled" also takes a letter pair in swapped order in one step of its table,
    from the row just above, so words with doubled letters can be nearer (mmal and mammal 1, kill and killl 0).
    """
    if kind == "edits":
        return F.call_function("levenshtein", token, word, most)
    assert kind == "doubled", kind

    def counted(a: Column, b: Column) -> Column:
        first = F.sequence(F.lit(0), F.size(b))

        def row(above: Column, c: Column, i: Column) -> Column:
            """The next row of the table: its last value is carried as each cell needs its left neighbour."""

            def cell(acc: Column, j: Column) -> Column:
                other = (c != F.get(b, j - 1)).cast("int")
                plain = F.least(F.get(above, j) + 1, F.get(acc, j - 1) + 1, F.get(above, j - 1) + other)
                swapped = (i > 0) & (j > 1) & (c == F.get(b, j - 2)) & (F.get(a, i - 1) == F.get(b, j - 1))
                return F.array_append(acc, F.when(swapped, F.least(plain, F.get(above, j - 2) + other)).otherwise(plain))

            return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(i + 1), cell)

        numbered = F.transform(a, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        total = F.aggregate(numbered, first, lambda above, x: row(above, x["c"], x["i"]))
        return F.element_at(total, -1)

    near = F.abs(F.length(token) - F.length(word)) <= most
    table = once(tx.chars(token), lambda a: once(tx.chars(word), lambda b: counted(a, b)))
    found = F.when((F.length(token) == 0) | (F.length(word) == 0), F.greatest(F.length(token), F.length(word))).otherwise(table)
    return F.when(near, once(found, lambda d: F.when(d <= most, d).otherwise(F.lit(-1)))).otherwise(F.lit(-1))


def tokens(messages: DataFrame, config: Fuzzy) -> DataFrame:
    """(keys, sizes, token, start) for the tokens of a message that are long enough."""
    rows = messages.select(*KEYS, *SIZES, F.explode(tx.alnum_tokens(F.lower("n"))).alias("t"))
    return rows.select(*KEYS, *SIZES, F.col("t.piece").alias("token"), F.col("t.start").alias("start")).where(F.length("token") >= config.min_word_length)


def candidate_counts(words: DataFrame, distance: int) -> DataFrame:
    """(token_length, candidates): words whose length is within distance of a token's; one row a length."""
    near = F.explode(F.sequence(F.length("word") - distance, F.length("word") + distance))
    return words.select(near.alias("token_length")).groupBy("token_length").agg(F.count("*").alias("candidates"))


def within_budget(tokens: DataFrame, words: DataFrame, config: Fuzzy) -> DataFrame:
    """Tokens in order, as long as the comparisons with all words of near lengths, theirs included, stay within max_checks."""
    counted = tokens.join(F.broadcast(candidate_counts(words, config.max_distance)), F.length("token") == F.col("token_length"))
    so_far = F.sum("candidates").over(Window.partitionBy(*KEYS).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("checks", so_far).where(F.col("checks") <= config.max_checks).drop("token_length", "candidates")


def nearest_words(vocabulary: DataFrame, words: DataFrame, config: Fuzzy) -> DataFrame:
    """(token, word, base_score, distance): each distinct token's nearest word; ties go to the shorter, then the earlier one.

    Lengths are spread so that the join is by hash; a word may differ by max_distance edits and distance_ratio of its length.
    """
    near = words.select("*", F.explode(F.sequence(F.length("word") - config.max_distance, F.length("word") + config.max_distance)).alias("token_length"))
    pairs = vocabulary.join(F.broadcast(near), F.length("token") == F.col("token_length"))
    pairs = pairs.withColumn("distance", F.levenshtein("token", "word", config.max_distance))
    pairs = pairs.where((F.col("distance") >= 0) & (F.col("distance") / F.length("word") <= config.distance_ratio))
    best = pairs.groupBy("token").agg(F.min(F.struct("distance", F.length("word").alias("length"), "ord", "word", "base_score")).alias("b"))
    return best.select("token", "b.word", "b.base_score", "b.distance")


def fuzzy_matches(messages: DataFrame, detected: DataFrame, words: DataFrame, config: Fuzzy) -> DataFrame:
    """Detections of tokens that aren't themselves among a message's detected words (keys, word)."""
    open_ = tokens(messages, config).join(detected.select(*KEYS, F.col("word").alias("token")).distinct(), [*KEYS, "token"], "left_anti")
    checked = within_budget(open_, words, config)
    best = nearest_words(checked.select("token").distinct(), words, config)
    rows = checked.join(best, "token").withColumns({"ord": F.lit(9), "end": F.col("start") + F.length("token"), "matched_form": F.col("token"), "homoglyphs_detected": F.array().cast("array<array<string>>")})
    return rows.select(*FOUND)


def deletions(text: Column, most: int) -> Column:
    """The distinct strings that are left of a text when up to `most` of its characters are deleted."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    found = F.array(text)
    for _ in range(most):
        found = once(found, lambda ts: F.array_distinct(F.concat(ts, F.flatten(F.transform(ts, lambda t: F.when(F.length(t) > 0, one(t)).otherwise(F.array().cast("array<string>")))))))
    return found


def near_pairs(vocabulary: DataFrame, words: DataFrame, config: Fuzzy) -> DataFrame:
    """(token, word, distance, ...) for every distinct token (column token) and every word within max_distance edits and distance_ratio of its length.

    Strings that are d edits apart have a string in common that is left of each after at most d deletions. So both sides are
    spelled out by their deletions and meet in a hash join; pairs that meet are measured. A row a word and deletion, not a row a pair.
    """
    of = lambda df, name: df.withColumn("_left", F.explode(deletions(F.col(name), config.max_distance)))
    listed = of(words.withColumn("_size", F.length("word")), "word")
    met = of(vocabulary.select("token").distinct(), "token").join(listed, "_left").where(F.abs(F.length("token") - F.col("_size")) <= config.max_distance)
    pairs = met.drop("_left", "_size").dropDuplicates(["token", "word"])
    pairs = pairs.withColumn("distance", F.levenshtein("token", "word", config.max_distance))
    return pairs.where((F.col("distance") >= 0) & (F.col("distance") / F.length("word") <= config.distance_ratio))


def with_indexed(rows: DataFrame, words: DataFrame, config: Config) -> DataFrame:
    """rows (keys, n, found, covered) with the fuzzy stage's detections, without a budget: every eligible token is compared with all near words.

    Tokens meet the words by near_pairs() once for each distinct token. A message's max_distance may only be less than the configuration's.
    """
    default = F.lit(config.fuzzy.max_distance)
    options = "options" in rows.columns
    most = F.least(F.coalesce("options.max_distance", default), default) if options else default
    on = F.coalesce("options.fuzzy", F.lit(config.fuzzy.enabled)) if options else F.lit(config.fuzzy.enabled)
    known = F.transform("found", lambda d: d["word"])
    long = F.filter(tx.alnum_tokens(F.lower("n")), lambda t: (F.length(t["piece"]) >= config.fuzzy.min_word_length) & ~F.array_contains(known, t["piece"]))
    open_ = rows.where(~F.col("covered") & on).select(*KEYS, most.alias("most"), F.explode(long).alias("t")).select(*KEYS, "most", F.col("t.piece").alias("token"), F.col("t.start").alias("start"))
    near = near_pairs(open_, words.select("word", "base_score", "ord"), config.fuzzy)
    rank = F.struct("distance", F.length("word").alias("length"), "ord", "word", "base_score")
    best = open_.join(near, "token").where("distance <= most").groupBy(*KEYS, "token", "start").agg(F.min(rank).alias("b"))
    item = F.struct(F.lit(9).alias("ord"), (F.col("start") + F.length("token")).cast("int").alias("end"), F.col("start").cast("int").alias("start"), F.col("b.word").alias("word"), F.col("b.base_score").alias("base_score"), F.col("token").alias("matched_form"), F.array().cast("array<array<string>>").alias("homoglyphs_detected"), F.col("b.distance").cast("int").alias("distance"))
    fuzzy = best.groupBy(*KEYS).agg(F.collect_list(item).alias("fuzzy"))
    return rows.join(fuzzy, KEYS, "left").withColumn("found", F.concat("found", F.coalesce(F.col("fuzzy"), F.slice("found", 1, 0)))).drop("fuzzy", "covered")
