"""A word list as data beside each message: the columns ``list`` and ``lengths`` that the row expressions read.

The expressions name these columns and never the words, so they are the same whatever the list: another list is another
row, not another plan. A short list is one row for all messages. Of a long one, each message gets the words that an anchor
search finds in any reading of it, which is all that the stages can find.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Fuzzy
from ..functions import text as tx
from ..functions.cached import built_once
from ..functions.chars import SPACE
from .match import find_all

WORD = "struct<ord: bigint, word: string, base_score: double, tags: array<string>>"
#: A regular expression that matches nothing.
NEVER = "(?!)"


def alternation(patterns: Iterable[str]) -> str:
    """A regular expression that finds a text with any of the patterns, branching by first character; none: never matches."""
    listed = sorted(set(patterns), key=len)
    least = [p for k, p in enumerate(listed) if not any(q in p for q in listed[:k])]
    by_first = defaultdict(list)
    for p in least:
        by_first[p[0]].append(re.escape(p[1:]))
    return "|".join(re.escape(c) + f"(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items())) or NEVER


def _any_of(patterns: Column) -> Column:
    """As alternation(), for the few patterns of one message."""
    quoted = F.transform(patterns, lambda p: F.concat(F.lit("\\Q"), F.replace(p["pattern"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size(patterns) > 0, F.array_join(quoted, "|")).otherwise(F.lit(NEVER))


def _patterns(words: Column, form: Callable[[Column], Column]) -> Column:
    """[(pattern, ahead, size, word, word_size, base_score), ...] of words' forms; empty forms go."""

    def made(w: Column) -> Column:
        return tx.once(form(w["word"]), lambda p: F.struct(p.alias("pattern"), tx.ahead_of(p).alias("ahead"), F.length(p).alias("size"), w["word"].alias("word"), F.length(w["word"]).alias("word_size"), w["base_score"].alias("base_score")))

    return F.filter(F.transform(words, made), lambda p: p["size"] > 0)


def list_of(words: Column, config: Config, tests: dict[str, Column] | None = None) -> Column:
    """The column ``list`` of an array of WORD: the patterns of each kind, a test of a text for any of them, and tags.

    Kinds: plain, clean (without ASCII separators) and runs (also with runs of letters collapsed). tests: their regular expressions, where they are known.
    """
    plain, clean = _patterns(words, lambda w: w), _patterns(words, tx.strip_non_alnum)
    collapsed = F.filter(_patterns(words, tx.collapse_to_one), lambda p: p["pattern"] != p["word"])
    kinds = {"plain": plain, "clean": clean, "runs": F.concat(plain, collapsed) if config.repetition.collapse_patterns else plain}
    fields = [F.struct(v.alias("listed"), (tests[k] if tests else _any_of(v)).alias("test")).alias(k) for k, v in kinds.items()]
    letters_only = ~F.exists(words, lambda w: tx.strip_non_alnum(w["word"]) != w["word"])
    twice = F.exists(collapsed, lambda p: F.endswith(p["word"], p["pattern"]))  # one match of such a word is found by both forms
    tags = F.map_from_entries(F.transform(words, lambda w: F.struct(w["word"], F.coalesce(w["tags"], F.array().cast("array<string>")))))
    return F.struct(*fields, letters_only.alias("letters_only"), twice.alias("twice"), tags.alias("tags"))


_LISTED = pa.struct({"ord": pa.int64(), "word": pa.string(), "base_score": pa.float64(), "tags": pa.list_(pa.string())})
_NEAR = pa.struct({"length": pa.int32(), "ord": pa.int64(), "word": pa.string(), "base_score": pa.float64()})


def shared(spark: SparkSession, words: list[Row], config: Config) -> DataFrame:
    """One row (list, lengths) of a bounded number of words (word, base_score, ord[, tags]).

    lengths, for the fuzzy stage: the number of words of each length, and the words themselves where they are within the budget.
    """
    listed = [{"ord": r["ord"], "word": r["word"], "base_score": r["base_score"], "tags": list(r["tags"] or []) if "tags" in r else []} for r in sorted(words, key=lambda r: r["ord"])]
    names = [r["word"] for r in listed]
    collapsed = [re.sub(r"(?s)(.)\1+", r"\1", w) for w in names] if config.repetition.collapse_patterns else []
    tests = {"plain": names, "clean": [c for w in names if (c := re.sub("[^a-zA-Z0-9]", "", w))], "runs": names + collapsed}
    counts = Counter(map(len, names))
    near = defaultdict(list)
    for r in listed:
        if counts[len(r["word"])] <= config.fuzzy.max_checks:
            near[len(r["word"])].append({"length": len(r["word"]), **{k: r[k] for k in ("ord", "word", "base_score")}})
    columns = {"words": pa.array([listed], pa.list_(_LISTED)), "counts": pa.array([list(counts.items())], pa.map_(pa.int32(), pa.int32())), "near": pa.array([list(near.items())], pa.map_(pa.int32(), pa.list_(_NEAR)))}
    columns |= {f"test_{k}": pa.array([alternation(v)]) for k, v in tests.items()}
    row = spark.createDataFrame(pa.table(columns))
    return row.select(_tested_list(config).alias("list"), _near_words().alias("lengths"))


@built_once
def _tested_list(config: Config) -> Column:
    return list_of(F.col("words"), config, {k: F.col(f"test_{k}") for k in ("plain", "clean", "runs")})


@built_once
def _near_words() -> Column:
    no_more = F.create_map().cast("map<string, array<string>>")  # the list's own tags are all
    return F.struct("counts", F.col("near").alias("words"), no_more.alias("tags"))


@built_once
def _found_list(config: Config) -> Column:
    listed = F.coalesce(F.col("words"), F.array().cast(f"array<{WORD}>"))
    return tx.once(listed, lambda ws: list_of(ws, config))


def lengths_of(words: DataFrame, config: Fuzzy) -> DataFrame:
    """One row (lengths) of a list of any length, as in shared(): at most max_checks words of each length."""
    sized = words.select(F.length("word").alias("length"), "ord", "word", "base_score", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    counts = sized.groupBy("length").agg(F.count("*").cast("int").alias("n"))
    within = sized.join(F.broadcast(counts.where(F.col("n") <= config.max_checks).select("length")), "length", "left_semi")  # a row a length
    listed = within.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("length", "ord", "word", "base_score"))).alias("words"), F.collect_list(F.struct("word", "tags")).alias("tags"))
    near = F.struct("length", "words")
    both = counts.join(listed, "length", "left")
    maps = [F.map_from_entries(F.collect_list(F.struct("length", "n"))).alias("counts"), F.map_from_entries(F.collect_list(F.when(F.col("words").isNotNull(), near))).alias("words"), F.map_from_entries(F.flatten(F.collect_list("tags"))).alias("tags")]
    return both.agg(*maps).select(F.struct("counts", "words", "tags").alias("lengths"))


#: Stages that search a message's own list, beside those whose matches the anchor search itself places.
SEARCHING = ("separator_bypass", "leetspeak", "repetition")


def may_run(name: str, config: Config, options: bool) -> bool:
    """Whether any message can have a stage on; with options every stage."""
    return options or getattr(config, name).enabled


@built_once
def reading(config: Config, options: bool = True) -> Column:
    """All readings of a normalised message n in one text, a line break between them: whatever a stage that may run can find in the message occurs in it.

    The message itself comes first, then, if look-alikes count and it has any, the message without them.
    """
    n = F.col("n")
    low, most, threshold = F.lower(n), config.leetspeak.max_expansions, config.repetition.threshold
    on = lambda name: may_run(name, config, options)

    def expanded(text: Column) -> Column:
        tokens = tx.leet_tokens(text, lambda piece: piece.rlike("[1|&]"))
        return F.when(text.rlike("[1|&]"), F.array_join(F.transform(tokens, lambda t: F.array_join(tx.leet_expansions(most)(t["piece"]), "\n")), "\n"))

    def seen(text: Column) -> list[Column]:
        runs = text.rlike(rf"(?d)(.)\1{{{threshold},}}")
        leet = [F.when(tx.has_leet(text), tx.greedy_leet(text)), expanded(text)] if on("leetspeak") else []
        return leet + ([F.when(runs, tx.collapse_repeats(text, threshold)), F.when(runs, tx.collapse_to_one(text))] if on("repetition") else [])

    def joined(text: Column) -> Column:
        stripped = F.regexp_replace(text, f"[^a-zA-Z0-9{'' if getattr(config.separator_bypass, 'spans', 'token') == 'message' else SPACE}]", "")
        look = tx.replace_homoglyphs(n)
        looks = [F.when(look != n, look)] if on("homoglyph") else []
        return F.concat_ws("\n", n, *looks, F.when(text != n, text), *([F.when(stripped != text, stripped)] if on("separator_bypass") else []), *seen(text))

    def cleaned(clean: Column) -> Column:
        return F.when(clean != n, tx.once(F.lower(clean), lambda text: F.concat_ws("\n", *seen(text))))

    rest = [tx.once(tx.strip_keep_leet(n), cleaned)] if on("leetspeak") or on("repetition") else []
    return F.concat_ws("\n", tx.once(low, joined), *rest)


def forms_of(words: DataFrame, config: Config, options: bool = True) -> DataFrame:
    """words with ``pattern``: each form of each word that a reading may hold."""
    forms = [F.col("word")] + ([tx.strip_non_alnum(F.col("word"))] if may_run("separator_bypass", config, options) else [])
    forms += [tx.collapse_to_one(F.col("word"))] if config.repetition.collapse_patterns and may_run("repetition", config, options) else []
    return words.select("*", F.explode(F.array_distinct(F.array(*forms))).alias("pattern")).where("pattern <> ''")


def _occurrences(messages: DataFrame, words: DataFrame, config: Config, keys: list[str], variant: str) -> DataFrame:
    """Every place of every form of a word in a message's reading, with the message's length and whether it has look-alikes."""
    options = "options" in messages.columns
    texts = messages.select(*keys, F.length("n").alias("_long"), (tx.replace_homoglyphs(F.col("n")) != F.col("n")).alias("_looks"), reading(config, options).alias("_reading"))
    return find_all(texts, "_reading", forms_of(words.select("ord", "word", "base_score", "tags"), config, options), variant)


def candidates(messages: DataFrame, words: DataFrame, config: Config, keys: list[str], variant: str = "anchor") -> DataFrame:
    """(keys, words) for the messages (keys, n) that hold a word in any reading: an array of WORD, in list order."""
    found = _occurrences(messages, words, config, keys, variant)
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("ord", "word", "base_score", "tags"))).alias("words"))


def with_candidates(messages: DataFrame, words: DataFrame, config: Config, keys: list[str], variant: str = "anchor", tags: bool = False) -> DataFrame:
    """messages with exact_hits and look_hits, and, if a stage needs them or with tags, list, of the words that each may hold, and lengths, of all words.

    Hits are arrays of (word, base_score, at): the words' places in the message, and those in the message without look-alikes
    where it reads otherwise. They come from the search itself, so these stages don't search again.
    """
    options = "options" in messages.columns
    searching = any(may_run(k, config, options) for k in SEARCHING)
    found = _occurrences(messages, words, config, keys, variant)
    at, size, long = F.col("at"), F.length("pattern"), F.col("_long")
    plain = F.col("pattern") == F.col("word")
    exact = plain & (at + size <= long)
    there = at - long - 1  # place in the second reading, which is the one without look-alikes if there are any
    otherwise = F.substring("_reading", there + 1, size) != F.col("word")
    look = F.col("_looks") & plain & (there >= 0) & (there + size <= long) & otherwise if may_run("homoglyph", config, options) else F.lit(False)
    hit = lambda where, place: F.when(where, F.struct("word", "base_score", place.cast("int").alias("at")))
    rows = found.select(*keys, F.struct("ord", "word", "base_score", "tags").alias("_word"), hit(exact, at).alias("_exact"), hit(look, there).alias("_look"))
    listed = [F.array_sort(F.collect_set("_word")).alias("words")] if searching or tags else []
    rows = rows if listed else rows.where("_exact is not null or _look is not null")
    hits = rows.groupBy(*keys).agg(F.collect_list("_exact").alias("exact_hits"), F.collect_list("_look").alias("look_hits"), *listed)
    out = messages.join(hits, keys, "left")
    out = out.withColumn("list", _found_list(config)).drop("words") if listed else out
    fuzzy = tags or (may_run("fuzzy", config, options) and config.fuzzy.max_checks > 0)
    return out.crossJoin(F.broadcast(lengths_of(words, config.fuzzy))) if fuzzy else out
