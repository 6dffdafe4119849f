"""The stages as array expressions over one message row and the word list beside it.

Nothing is joined or shuffled: a message's detections of all stages, their resolution and the fuzzy stage are columns of
its row. Every reading is first tested with one regular expression over the whole list, so that most messages of most
stages cost that test alone. The expressions read the list from the columns that ``wordlist`` makes, so they are built once
a configuration. Ordinals and offsets are those of ``stages``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, Fuzzy
from ..functions import text as tx
from ..functions.cached import built_once
from ..functions.chars import SPACE
from .fuzzy import distance_of

#: Detections sort in this order of fields.
FOUND = "struct<ord: int, end: int, start: int, word: string, base_score: double, matched_form: string, homoglyphs_detected: array<array<string>>, distance: int>"


@dataclass(frozen=True)
class Patterns:
    """One kind of the list's patterns: an array of (pattern, ahead, size, word, word_size, base_score), and a test of a text for any of them."""

    listed: Column
    test: Column

    @staticmethod
    def of(kind: str) -> Patterns:
        return Patterns(F.col(f"list.{kind}.listed"), F.col(f"list.{kind}.test"))

    def found_in(self, text: Column) -> Column:
        """regexp_instr keeps the compiled expression for as long as its text is the same, which rlike doesn't."""
        return F.regexp_instr(text, self.test) > 0


@dataclass(frozen=True)
class Listed:
    """The word list as columns of a message's row (see wordlist.list_of)."""

    plain: Patterns
    clean: Patterns
    runs: Patterns
    letters_only: Column  # no word changes when ASCII separators are stripped
    twice: Column  # a word's collapsed form ends the word, so one match can be found by both

    @staticmethod
    def columns() -> Listed:
        return Listed(*map(Patterns.of, ("plain", "clean", "runs")), F.col("list.letters_only"), F.col("list.twice"))


def _none() -> Column:
    return F.array().cast(f"array<{FOUND}>")


def _detection(ord_: int, word: Column, base_score: Column, start: Column, end: Column, form: Column, pairs: Column | None = None, distance: Column | None = None) -> Column:
    pairs = F.array().cast("array<array<string>>") if pairs is None else pairs
    distance = F.lit(None) if distance is None else distance
    columns = {"ord": F.lit(ord_), "end": end.cast("int"), "start": start.cast("int"), "word": word, "base_score": base_score, "matched_form": form, "homoglyphs_detected": pairs, "distance": distance.cast("int")}
    return F.struct(*(c.alias(k) for k, c in columns.items()))


def _hits(text: Column, patterns: Patterns, make: Callable[[Column, Column], Column]) -> Column:
    """make(start, pattern) for every occurrence of a pattern in text, which must be an attribute or a lambda's variable."""
    held = F.filter(patterns.listed, lambda p: F.contains(text, p["pattern"]))
    return F.flatten(F.transform(held, lambda p: F.transform(tx.places(text, p["pattern"], p["ahead"]), lambda at: make(at, p))))


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def exact(n: Column, c: Listed) -> Column:
    made = tx.once(n, lambda t: _hits(t, c.plain, lambda at, p: _detection(2, p["word"], p["base_score"], at, at + p["size"], p["pattern"])))
    return F.when(c.plain.found_in(n), made).otherwise(_none())


def look_alikes(n: Column, c: Listed) -> Column:
    def of(look: Column, t: Column, pairs: Column) -> Column:
        def make(at: Column, p: Column) -> Column:
            def formed(form: Column) -> Column:
                return _detection(3, p["word"], p["base_score"], at, at + p["size"], form, F.filter(pairs, lambda x: F.contains(form, F.get(x, 0))))

            return tx.once(_cut(t, at, at + p["size"]), formed)

        return _hits(look, c.plain, make)

    read = lambda t: tx.once(tx.replace_homoglyphs(t), lambda look: F.when((look != t) & c.plain.found_in(look), tx.once(tx.homoglyph_pairs(t), lambda pairs: of(look, t, pairs))).otherwise(_none()))
    return tx.once(n, read)


def _placed(hits: str) -> Column:
    return F.coalesce(F.col(hits), F.array().cast("array<struct<word: string, base_score: double, at: int>>"))


def exact_placed() -> Column:
    """As exact(), of a message whose exact_hits are known."""
    return F.transform(_placed("exact_hits"), lambda h: _detection(2, h["word"], h["base_score"], h["at"], h["at"] + F.length(h["word"]), h["word"]))


def look_alikes_placed(n: Column) -> Column:
    """As look_alikes(), of a message whose look_hits are known, without places where the message holds the word as it is: its exact stage has the word."""

    def made(pairs: Column, h: Column) -> Column:
        stop = h["at"] + F.length(h["word"])
        formed = lambda form: _detection(3, h["word"], h["base_score"], h["at"], stop, form, F.filter(pairs, lambda x: F.contains(form, F.get(x, 0))))
        return tx.once(_cut(n, h["at"], stop), formed)

    hits = _placed("look_hits")
    return F.when(F.size(hits) > 0, tx.once(tx.homoglyph_pairs(n), lambda pairs: F.transform(hits, lambda h: made(pairs, h)))).otherwise(_none())


def separated(low: Column, c: Listed, only_changed: Column, across: bool = False) -> Column:
    """only_changed leaves out spans of letters and digits alone, where the exact stage finds the same words. across takes the whole text as one span."""

    def span(s: Column) -> Column:
        source, base = s["piece"], s["start"]

        def make(at: Column, p: Column, places: Column, clean: Column) -> Column:
            last = at + p["size"] - 1
            first = last - p["word_size"] + 1
            place = lambda i: F.when(i >= 0, F.get(places, i))
            begin, stop = F.coalesce(place(first), F.lit(0)), F.coalesce(place(last) + 1, F.length(source) - 1)
            return _detection(4, p["word"], p["base_score"], base + begin, base + stop, _cut(source, begin, stop))

        return tx.once(tx.strip_non_alnum(source), lambda clean: tx.once(tx.alnum_places(source), lambda places: _hits(clean, c.clean, lambda at, p: make(at, p, places, clean))))

    def wanted(piece: Column) -> Column:
        found = c.clean.found_in(tx.strip_non_alnum(piece))
        return (~only_changed | piece.rlike("[^a-zA-Z0-9]")) & found

    # a word within a span stays in one piece when all but letters, digits and blanks go
    within = "" if across else SPACE
    gate = c.clean.found_in(F.regexp_replace(low, f"[^a-zA-Z0-9{within}]", ""))
    gate = (~only_changed | low.rlike(f"[^a-zA-Z0-9{within}]")) & gate
    whole = lambda t: F.array(F.struct(F.lit(0).alias("start"), t.alias("piece")))
    made = tx.once(low, lambda t: F.flatten(F.transform(whole(t) if across else tx.separator_spans(t, wanted), span)))
    return F.when(gate, made).otherwise(_none())


def leet(low: Column, ord_: int, c: Listed, most: int, exhaustive: bool = True) -> Column:
    """Tokens by their likeliest reading; exhaustive also tries all readings of those that show no word that way."""

    def token(t: Column) -> Column:
        source, base = t["piece"], t["start"]
        end = base + F.length(source)

        def rest(_: Column) -> Column:
            """Of all readings: the shortest word, in the first reading that has it."""

            def best(readings: Column) -> Column:
                each = lambda p: F.transform(F.filter(readings, lambda r: F.contains(r["reading"], p["pattern"])), lambda r: F.struct(p["size"].alias("size"), r["k"].alias("k"), (F.instr(r["reading"], p["pattern"]) + p["size"]).alias("until"), p["word"].alias("word"), p["base_score"].alias("base_score"), r["reading"].alias("reading")))
                least = F.array_min(F.flatten(F.transform(c.plain.listed, each)))
                return F.when(F.size(readings) > 0, tx.once(least, lambda b: F.array(_detection(ord_, b["word"], b["base_score"], base, end, b["reading"])))).otherwise(_none())

            numbered = F.transform(tx.leet_expansions(most)(source), lambda r, k: F.struct(k.alias("k"), r.alias("reading")))
            return tx.once(F.filter(numbered, lambda r: c.plain.found_in(r["reading"])), best)

        def greedy(view: Column) -> Column:
            words = F.transform(F.filter(c.plain.listed, lambda p: F.contains(view, p["pattern"])), lambda p: _detection(ord_, p["word"], p["base_score"], base, end, source))
            found = F.when(c.plain.found_in(view), words)
            return (found.when(source.rlike("[1|&]"), rest(view)) if exhaustive else found).otherwise(_none())

        return tx.once(tx.greedy_leet(source), greedy)

    def of(t: Column) -> Column:
        wanted = lambda piece: tx.has_leet(piece) & (piece.rlike("[1|&]") | c.plain.found_in(tx.greedy_leet(piece)))
        return F.flatten(F.transform(tx.leet_tokens(t, wanted), token))

    gate = tx.has_leet(low) & (low.rlike("[1|&]") | c.plain.found_in(tx.greedy_leet(low)))
    return F.when(gate, tx.once(low, of)).otherwise(_none())


def repeats(low: Column, ord_: int, c: Listed, threshold: int) -> Column:
    """Ends are inclusive. Once runs are collapsed to one, only the first match of a word that the longer runs didn't show."""

    def placed(kept: Column, t: Column, last: Column, word_size: Column) -> tuple[Column, Column]:
        first = last - word_size + 1
        return F.when(first <= 0, F.lit(0)).otherwise(F.get(kept, first - 1) + 1), F.get(kept, last)

    def made(kept: Column, t: Column, last: Column, p: Column) -> Column:
        start, end = placed(kept, t, last, p["word_size"])
        return tx.once(F.struct(start.alias("a"), end.alias("b")), lambda x: _detection(ord_, p["word"], p["base_score"], x["a"], x["b"], _cut(t, x["a"], x["b"] + 1)))

    def of(t: Column, two: Column) -> Column:
        longer = tx.once(tx.kept_places(t, threshold, keep_lines=True), lambda kept: _hits(two, c.runs, lambda at, p: made(kept, t, at + p["size"] - 1, p)))
        longer = F.when(c.runs.found_in(two), tx.once(longer, lambda ds: F.when(c.twice, F.array_distinct(ds)).otherwise(ds))).otherwise(_none())

        def short(one: Column, long: Column) -> Column:
            known = F.transform(long, lambda d: d["word"])
            ends = _hits(one, c.runs, lambda at, p: F.struct((at + p["size"] - 1).alias("last"), at.alias("at"), p["pattern"].alias("pattern"), p["word"].alias("word"), p["word_size"].alias("word_size"), p["base_score"].alias("base_score")))

            def firsts(new: Column) -> Column:
                least = F.transform(F.array_distinct(F.transform(new, lambda h: h["word"])), lambda w: F.array_min(F.filter(new, lambda h: h["word"] == w)))
                return tx.once(tx.kept_places(t, 1, keep_lines=False), lambda kept: F.transform(least, lambda h: made(kept, t, h["last"], h)))

            fresh = tx.once(known, lambda ws: F.filter(ends, lambda h: ~F.array_contains(ws, h["word"])))
            return F.when((one != two) & c.runs.found_in(one), tx.once(fresh, firsts)).otherwise(_none())

        return tx.once(longer, lambda long: F.concat(long, tx.once(tx.collapse_to_one(t), lambda one: short(one, long))))

    def read(t: Column) -> Column:
        return tx.once(tx.collapse_repeats(t, threshold), lambda two: F.when(two == t, _none()).otherwise(of(t, two)))

    # no run over the threshold, nothing to do
    return F.when(low.rlike(rf"(?d)(.)\1{{{threshold},}}"), tx.once(low, read)).otherwise(_none())


def across_spans(config: Config) -> bool:
    return getattr(config.separator_bypass, "spans", "token") == "message"


def wanted(name: str, config: Config, options: bool) -> Column:
    """Whether a stage is on: the message's option, or else the configuration."""
    default = F.lit(getattr(config, name).enabled)
    return F.coalesce(F.col(f"options.{name}"), default) if options else default


@built_once
def _stage_column(ord_: int, config: Config, only_changed: bool, exhaustive: bool) -> Column:
    n, c = F.col("n"), Listed.columns()
    low, threshold, most = F.lower(n), config.repetition.threshold, config.leetspeak.max_expansions

    def on_clean(f: Callable[[Column], Column]) -> Column:
        return tx.once(tx.strip_keep_leet(n), lambda k: F.when(k != n, tx.once(F.lower(k), f)).otherwise(_none()))

    made = {
        2: lambda: exact(n, c),
        3: lambda: look_alikes(n, c),
        4: lambda: separated(low, c, F.lit(only_changed and not config.case_sensitive) & c.letters_only, across_spans(config)),
        5: lambda: leet(low, 5, c, most, exhaustive),
        6: lambda: repeats(low, 6, c, threshold),
        7: lambda: on_clean(lambda t: leet(t, 7, c, most, exhaustive)),
        8: lambda: on_clean(lambda t: repeats(t, 8, c, threshold)),
    }
    return made[ord_]()


def stage_column(ord_: int, config: Config, only_changed: bool = False, exhaustive: bool = True) -> Column:
    """The detections of one stage of a prepared message with its list, for itself."""
    return _stage_column(ord_, config, only_changed, exhaustive)


STAGE_NAMES = {3: "homoglyph", 4: "separator_bypass", 5: "leetspeak", 6: "repetition", 7: "leetspeak", 8: "repetition"}


def resolved(stages: list[Column]) -> Column:
    """The detections of all stages in order, each word only from the first stage that finds it."""
    words = lambda ds: F.array_distinct(F.transform(ds, lambda d: d["word"]))
    start = F.struct(F.array().cast("array<string>").alias("known"), _none().alias("out"))

    def step(acc: Column, found: Column) -> Column:
        new = F.filter(found, lambda d: ~F.array_contains(acc["known"], d["word"]))
        return F.when(F.size(found) == 0, acc).otherwise(tx.once(new, lambda x: F.struct(F.array_union(acc["known"], words(x)).alias("known"), F.concat(acc["out"], x).alias("out"))))

    return F.aggregate(F.array(*stages), start, step)["out"]


_WORD = "struct<length: int, ord: bigint, word: string, base_score: double>"


def _around(token: Column, most: Column) -> Column:
    return F.sequence(F.length(token) - most, F.length(token) + most)


def near_lengths(token: Column, words: Column, most: Column) -> Column:
    """The words (a map by length, of arrays of _WORD) whose length is within `most` of a token's."""
    return F.flatten(F.transform(_around(token, most), lambda k: F.coalesce(F.try_element_at(words, k), F.array().cast(f"array<{_WORD}>"))))


def eligible_tokens(low: Column, detected_words: Column, config: Fuzzy) -> Column:
    """(k, token) of a text's tokens that are long enough and aren't themselves detected words."""
    numbered = F.transform(tx.runs_of(low, tx.ALNUM), lambda t, k: F.struct(k.alias("k"), t.alias("token")))
    return F.filter(numbered, lambda t: (F.length(t["token"]) >= config.min_word_length) & ~F.array_contains(detected_words, t["token"]))


def compared_tokens(open_: Column, counts: Column, config: Fuzzy, most: Column) -> Column:
    """(k, token, before, own) of the eligible tokens that are compared: as long as the comparisons with all words of near lengths stay within the budget."""
    number = lambda token: F.aggregate(_around(token, most), F.lit(0), lambda n, k: n + F.coalesce(F.try_element_at(counts, k), F.lit(0)))

    def kept(ns: Column) -> Column:
        before = tx.sums_before(ns)
        spent = F.zip_with(F.zip_with(open_, before, lambda t, x: F.struct(t["k"].alias("k"), t["token"].alias("token"), x.alias("before"))), ns, lambda t, n: F.struct(t["k"].alias("k"), t["token"].alias("token"), t["before"].alias("before"), n.alias("own")))
        return F.filter(spent, lambda x: (x["own"] > 0) & (x["before"] + x["own"] <= config.max_checks))

    return tx.once(F.transform(open_, lambda t: number(t["token"])), kept)


def nearest(low: Column, found: Column, words: Column, counts: Column, config: Fuzzy, most: Column) -> Column:
    """Fuzzy detections of the tokens that aren't themselves detected words, in order, as long as the comparisons with all words of near lengths stay within the budget."""
    def best(token: Column) -> Column:
        close = F.transform(near_lengths(token, words, most), lambda w: F.struct(distance_of(token, w["word"], most, config.distance).alias("distance"), w["length"].alias("length"), w["ord"].alias("ord"), w["word"].alias("word"), w["base_score"].alias("base_score")))
        return F.array_min(F.filter(close, lambda w: (w["distance"] >= 0) & (w["distance"] / w["length"] <= config.distance_ratio)))

    def within(open_: Column) -> Column:
        """(k, best) of each token within the budget that has a near word; open_ is (k, token) of the eligible ones."""
        return F.filter(F.transform(compared_tokens(open_, counts, config, most), lambda x: F.struct(x["k"].alias("k"), best(x["token"]).alias("best"))), lambda x: x["best"].isNotNull())

    def placed(x: Column, tokens: Column) -> Column:
        t, b = F.get(tokens, x["k"]), x["best"]
        return tx.once(t, lambda t: _detection(9, b["word"], b["base_score"], t["start"], t["start"] + F.length(t["piece"]), t["piece"], distance=b["distance"]))

    def of(ws: Column) -> Column:
        found = tx.once(eligible_tokens(low, ws, config), within)
        # tokens' places are looked up only where one is near a word
        return tx.once(found, lambda xs: F.when(F.size(xs) > 0, tx.once(tx.alnum_tokens(low), lambda ts: F.transform(xs, lambda x: placed(x, ts)))).otherwise(_none()))

    return tx.once(F.transform(found, lambda d: d["word"]), of)


@built_once
def _found_column(config: Config, options: bool, placed: bool) -> Column:
    of = lambda k: look_alikes_placed(F.col("n")) if placed and k == 3 else stage_column(k, config, only_changed=k == 4)
    stages = [F.when(~F.col("covered") & wanted(name, config, options), of(k)).otherwise(_none()) for k, name in STAGE_NAMES.items() if options or getattr(config, name).enabled]
    return resolved([F.col("exact"), *stages])


def with_exact(messages: DataFrame, config: Config) -> DataFrame:
    """messages with ``exact``, the exact stage's detections, and ``covered``: whether their lengths, overlaps counted each time, reach the message's."""
    rows = messages.withColumn("exact", exact_placed() if "exact_hits" in messages.columns else stage_column(2, config))
    total = F.aggregate("exact", F.lit(0), lambda a, d: a + d["end"] - d["start"])
    return rows.withColumn("covered", total >= F.col("n_length"))


def detected(messages: DataFrame, config: Config) -> DataFrame:
    """messages (prepared, with the columns list and lengths, or, where no stage on needs these, with hits) with ``found``: an array of FOUND of all stages, unsorted. Without a budget the fuzzy stage is left to fuzzy.with_indexed(), and ``covered`` stays."""
    rows = with_exact(messages, config)
    rows = rows.withColumn("found", _found_column(config, "options" in rows.columns, "exact_hits" in rows.columns))
    return (rows if config.fuzzy.max_checks == 0 else with_fuzzy(rows, config).drop("covered")).drop("exact")


@built_once
def _fuzzy_column(config: Config, options: bool) -> Column:
    most = F.coalesce(F.col("options.max_distance"), F.lit(config.fuzzy.max_distance)) if options else F.lit(config.fuzzy.max_distance)
    near = tx.once(F.lower("n"), lambda low: nearest(low, F.col("found"), F.col("lengths.words"), F.col("lengths.counts"), config.fuzzy, most))
    return F.when(~F.col("covered") & wanted("fuzzy", config, options), near).otherwise(_none())


def with_fuzzy(rows: DataFrame, config: Config) -> DataFrame:
    """rows (n, found, covered, lengths[, options]) with the fuzzy stage's detections added to found."""
    if not config.fuzzy.enabled and "options" not in rows.columns:
        return rows
    near = _fuzzy_column(config, "options" in rows.columns)
    return rows.withColumn("fuzzy", near).withColumn("found", F.concat("found", "fuzzy")).drop("fuzzy")
