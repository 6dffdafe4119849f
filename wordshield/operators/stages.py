"""Detection stages as rows: every reading of a message is a row, and one search finds all their matches.

The scan takes ``rowwise``; this is the plainer form of its stages but the exhaustive readings and the fuzzy stage, and a check of it.

Ordinals: 2 exact, 3 look-alikes, 4 separators, 5 leetspeak, 6 repetition, 7 and 8 leetspeak and repetition over the whole
message without other characters, 9 fuzzy. Offsets are in the normalised text, for 7 and 8 in the cleaned one; a
repetition's end is inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as tx

KEYS = ["message_id", "text_key"]
METHOD = {2: "exact", 3: "homoglyph", 4: "separator_bypass", 5: "leetspeak", 6: "repetition", 7: "leetspeak", 8: "repetition", 9: "fuzzy"}
_VIEW = "struct<ord: int, kind: string, view: string, source: string, base: int, level: int>"
_PAIRS = "array<array<string>>"
#: What a message brings to each of its rows, so that no later step has to fetch it.
SIZES = ["n_length", "word_count"]
FOUND = [*KEYS, *SIZES, "ord", "word", "base_score", "matched_form", "start", "end", "homoglyphs_detected", "distance"]


def patterns_of(words: DataFrame, config: Config) -> DataFrame:
    """words (word, base_score, ord) -> (pattern, pattern_kind, word, base_score): plain, without ASCII separators, and with runs collapsed."""
    plain = words.select(F.col("word").alias("pattern"), F.lit("plain").alias("pattern_kind"), "word", "base_score")
    clean = words.select(tx.strip_non_alnum(F.col("word")).alias("pattern"), F.lit("clean").alias("pattern_kind"), "word", "base_score").where("pattern <> ''")
    runs = words.select(F.col("word").alias("pattern"), F.lit("runs").alias("pattern_kind"), "word", "base_score")
    if config.repetition.collapse_patterns:
        runs = runs.union(runs.withColumn("pattern", tx.collapse_to_one(F.col("word"))).where("pattern <> word"))
    return plain.union(clean).union(runs)


def _view(ord_: int, kind: str, view: Column, source: Column, base=0, level: int = 0) -> Column:
    base = base if isinstance(base, Column) else F.lit(base)
    return F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), view.alias("view"), source.alias("source"), base.cast("int").alias("base"), F.lit(level).alias("level"))


def _enabled(name: str, default: bool, options: bool) -> Column:
    return F.coalesce(F.col(f"options.{name}"), F.lit(default)) if options else F.lit(default)


def _none() -> Column:
    return F.array().cast(f"array<{_VIEW}>")


def _leet_views(source: Column, ord_: int) -> Column:
    tokens = F.filter(tx.leet_tokens(F.lower(source)), lambda t: tx.has_leet(t["piece"]))
    return F.when(tx.has_leet(source), F.transform(tokens, lambda t: _view(ord_, "plain", tx.greedy_leet(t["piece"]), t["piece"], t["start"]))).otherwise(_none())


def _run_views(source: Column, ord_: int, threshold: int) -> Column:
    low = F.lower(source)
    two, one = tx.collapse_repeats(low, threshold), tx.collapse_to_one(low)
    both = F.array(_view(ord_, "runs", two, low, level=threshold), _view(ord_, "runs", one, low, level=1))
    return F.when(two == low, _none()).when(one == two, F.slice(both, 1, 1)).otherwise(both)


def views(messages: DataFrame, config: Config) -> DataFrame:
    """(keys, ord, kind, view, source, base, level, places, pairs) for every reading of every message (keys, n[, options]).

    places and pairs, which every match of a reading looks up, are made once a reading.
    """
    options = "options" in messages.columns
    on = lambda name: _enabled(name, getattr(config, name).enabled, options)
    read = messages.withColumns({"low": F.lower("n"), "look": tx.replace_homoglyphs(F.col("n")), "clean": tx.strip_keep_leet(F.col("n"))})
    n, look, clean = F.col("n"), F.col("look"), F.col("clean")
    spans = F.transform(tx.separator_spans(F.col("low")), lambda s: _view(4, "clean", tx.strip_non_alnum(s["piece"]), s["piece"], s["start"]))
    changed = clean != n
    parts = [
        F.array(_view(2, "plain", n, n)),
        F.when(on("homoglyph") & (look != n), F.array(_view(3, "plain", look, n))).otherwise(_none()),
        F.when(on("separator_bypass"), spans).otherwise(_none()),
        F.when(on("leetspeak"), _leet_views(n, 5)).otherwise(_none()),
        F.when(on("repetition"), _run_views(n, 6, config.repetition.threshold)).otherwise(_none()),
        F.when(on("leetspeak") & changed, _leet_views(clean, 7)).otherwise(_none()),
        F.when(on("repetition") & changed, _run_views(clean, 8, config.repetition.threshold)).otherwise(_none()),
    ]
    exploded = read.select(*KEYS, *SIZES, F.explode(F.concat(*(p.cast(f"array<{_VIEW}>") for p in parts))).alias("v"))
    rows = exploded.select(*KEYS, *SIZES, "v.*").where("view <> ''")
    source, ord_ = F.col("source"), F.col("ord")
    kept = F.when(F.col("level") == 1, tx.kept_places(source, 1, keep_lines=False)).otherwise(tx.kept_places(source, config.repetition.threshold, keep_lines=True))
    places = F.when(ord_ == 4, tx.alnum_places(source)).when(ord_.isin(6, 8), kept)
    return rows.withColumns({"places": places, "pairs": F.when(ord_ == 3, tx.homoglyph_pairs(source)).otherwise(F.array().cast(_PAIRS))})


#: Text whose matches one task sorts; they take a hundred times as much there if a message holds many words.
PIECE_BYTES = 4 << 20


def pieces_of(text_bytes: int) -> int:
    """Partitions for the matches of texts of so many bytes. Spark's own choice merges partitions by compressed bytes, so a task's share would grow with the input."""
    return max(1, -(-text_bytes // PIECE_BYTES))


def _dealt(rows: DataFrame, pieces: int | None) -> DataFrame:
    return rows.repartition(pieces, *KEYS) if pieces else rows.repartition(*KEYS)


def located(matches: DataFrame, config: Config, pieces: int | None = None) -> DataFrame:
    """Matches of views (at, pattern, word) as detections with places in the message, in a number of partitions (see pieces_of; default: Spark's)."""
    last = F.col("at") + F.length("pattern") - 1
    first = last - F.length("word") + 1  # a shortened pattern moves its word's start to the left
    ord_, source, base, level = F.col("ord"), F.col("source"), F.col("base"), F.col("level")
    rows = matches.withColumns({"first": first, "last": last})
    place = lambda i: F.when(i >= 0, F.get("places", i))
    start = (
        F.when(ord_.isin(2, 3), F.col("first"))
        .when(ord_ == 4, base + F.coalesce(place(F.col("first")), F.lit(0)))
        .when(ord_.isin(5, 7), base)
        .otherwise(F.when(F.col("first") <= 0, F.lit(0)).otherwise(place(F.col("first") - 1) + 1))
    )
    end = (
        F.when(ord_.isin(2, 3), F.col("last") + 1)
        .when(ord_ == 4, base + F.coalesce(place(F.col("last")) + 1, F.length(source) - 1))
        .when(ord_.isin(5, 7), base + F.length(source))
        .otherwise(place(F.col("last")))
    )
    rows = rows.withColumns({"start": start.cast("int"), "end": end.cast("int")})
    stop = F.when(ord_.isin(6, 8), F.col("end") + 1).otherwise(F.col("end"))
    form = F.when(ord_.isin(5, 7), source).otherwise(F.substring(source, F.col("start") - base + 1, F.greatest(stop - F.col("start"), F.lit(0))))
    rows = rows.withColumn("matched_form", form)
    pairs = F.filter("pairs", lambda p: F.contains(F.col("matched_form"), F.get(p, 0)))
    rows = rows.withColumns({"homoglyphs_detected": pairs, "distance": F.lit(None).cast("int")}).select(*FOUND, "level", "last", "at", "pattern")
    # once runs are collapsed to one, only the first match of a word that the longer runs didn't show
    rows = _dealt(rows, pieces)
    mine = Window.partitionBy(*KEYS, "ord", "word").orderBy("last", "at", "pattern")  # one sort for both
    long = F.max((level > 1).cast("int")).over(mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nth = F.row_number().over(mine)
    one = ord_.isin(6, 8) & (level == 1)
    return rows.withColumns({"has_long": long, "nth": nth}).where(~one | ((F.col("has_long") == 0) & (F.col("nth") == 1))).select(*FOUND)


def resolved(found: DataFrame, pieces: int | None = None) -> DataFrame:
    """found, one row a (word, start, end, method): each word only from its first stage, and of messages that exact matches cover nothing else.

    Coverage adds up exact matches' lengths, overlaps counted each time, but a repeated row once. One sort serves the three windows, as each one's columns begin the one's before.
    """
    per_message, per_word = Window.partitionBy(*KEYS), Window.partitionBy(*KEYS, "word")
    same = Window.partitionBy(*KEYS, "word", "start", "end", "ord").orderBy("matched_form")
    rows = _dealt(found, pieces) if pieces else found
    once = rows.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    exact = F.sum(F.when(F.col("ord") == 2, F.col("end") - F.col("start")).otherwise(0)).over(per_message)
    kept = once.withColumn("earliest", F.min("ord").over(per_word)).withColumn("covered", exact >= F.col("n_length"))
    kept = kept.where((F.col("ord") == F.col("earliest")) & ((F.col("ord") == 2) | ~F.col("covered")))
    method = F.create_map(*(F.lit(x) for k, v in METHOD.items() for x in (k, v)))
    return kept.withColumn("method", F.element_at(method, F.col("ord"))).select(*FOUND, "method", "covered")
