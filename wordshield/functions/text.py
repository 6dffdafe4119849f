"""Text functions as column expressions; only Unicode NFKC and capped leet expansion need Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import ALNUM, HOMOGLYPH_FROM, HOMOGLYPH_TO, LEET, LEET_CLASS, LEET_FROM, LEET_TO, SPACE


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def normalize(text: Column, case_sensitive: bool = False) -> Column:
    """NFKC, then lower case unless case_sensitive."""
    out = _nfkc(text)
    return out if case_sensitive else F.lower(out)


def truncate(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def chars(text: Column) -> Column:
    """The characters of a text, as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def replace_homoglyphs(text: Column) -> Column:
    return F.translate(text, HOMOGLYPH_FROM, HOMOGLYPH_TO)


def homoglyph_pairs(text: Column) -> Column:
    """[[seen, read as], ...] for every look-alike character, in order, with repeats."""
    found = F.regexp_extract_all(text, F.lit(f"[{HOMOGLYPH_FROM}]"), F.lit(0))
    return F.transform(found, lambda c: F.array(c, replace_homoglyphs(c)))


def strip_non_alnum(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]", "")


def strip_keep_leet(text: Column) -> Column:
    """The text without all characters that are neither letters, digits nor leetspeak."""
    return F.regexp_replace(text, f"[^{ALNUM}{LEET_CLASS}]", "")


def collapse_repeats(text: Column, threshold: int = 2) -> Column:
    """Runs of more than threshold equal characters, line ends excepted, become exactly threshold."""
    return F.regexp_replace(text, rf"(?d)(.)\1{{{threshold},}}", "$1" * max(1, threshold))


def collapse_to_one(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")


def once(value: Column, use) -> Column:
    """use(value) with value computed once, though use names it often or for each element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def sums_before(sizes: Column, block: int = 16) -> Column:
    """For each of an array of sizes, the sum of those before it.

    Blocks are summed each for itself and then shifted by the blocks before, since appending copies an array.
    """
    none = F.array().cast("array<int>")

    def walked(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("upto"), none.alias("before"))
        return F.aggregate(xs, start, lambda acc, x: F.struct((acc["upto"] + x).alias("upto"), F.array_append(acc["before"], acc["upto"]).alias("before")))

    def shifted(parts: Column) -> Column:
        bases = walked(F.transform(parts, lambda p: p["upto"]))["before"]
        return F.flatten(F.zip_with(parts, bases, lambda p, base: F.transform(p["before"], lambda x: x + base)))

    def blocked(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(block))
        return F.when(F.size(xs) <= block, walked(xs)["before"]).otherwise(once(F.transform(starts, lambda b: walked(F.slice(xs, b + 1, block))), shifted))

    return once(sizes, blocked)


def places(text: Column, pattern: Column, ahead: Column) -> Column:
    """Starts (from 0) of a pattern in a text, overlapping ones too; ahead is the pattern as a look-ahead (see ahead_of)."""
    parts = F.split(text, ahead)
    return F.filter(sums_before(F.transform(parts, lambda p: F.length(p))), lambda at, k: (k > 0) | F.startswith(text, pattern))


def ahead_of(pattern: Column) -> Column:
    """A regular expression that matches the empty string before each occurrence of a literal pattern."""
    return F.concat(F.lit("(?=\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))


def kept_places(text: Column, n: int, keep_lines: bool) -> Column:
    """Indices (from 0) of the characters that collapsing runs to n keeps; keep_lines: runs of line ends stay."""

    def dropped(cs: Column, c: Column, i: Column) -> Column:
        same = i >= n
        for k in range(1, n + 1):
            same = same & (F.get(cs, i - k) == c)
        return same & (c != "\n") if keep_lines else same

    return once(chars(text), lambda cs: F.filter(F.transform(cs, lambda c, i: F.when(dropped(cs, c, i), F.lit(-1)).otherwise(i)), lambda i: i >= 0))


def alnum_places(text: Column) -> Column:
    """Indices (from 0) of the letters and digits of a text."""
    return F.filter(F.transform(chars(text), lambda c, i: F.when(c.rlike(f"[{ALNUM}]"), i).otherwise(-1)), lambda i: i >= 0)


def has_leet(text: Column) -> Column:
    return text.rlike(f"[{LEET_CLASS}]")


def greedy_leet(text: Column) -> Column:
    return F.translate(text, LEET_FROM, LEET_TO)


def leet_expansions(cap: int):
    """Column function: the distinct readings of a token, its characters' letters multiplied out from left to right.

    Each character makes a generation, as large as the one before times the character's letters. Once the generations
    together have over cap readings, the readings are those of the last complete generation and as many of the next as
    bring the count to cap + 1: beginnings of the token.
    """
    letters = F.create_map(*(x for c, to in LEET.items() for x in (F.lit(c), F.array(*map(F.lit, to)))))

    def grow(acc: Column, c: Column) -> Column:
        each = F.coalesce(F.try_element_at(letters, c), F.array(c))
        product = F.flatten(F.transform(acc["readings"], lambda p: F.transform(each, lambda x: F.concat(p, x))))

        def counted(new: Column) -> Column:
            total = acc["total"] + F.size(new)
            head = F.concat(acc["readings"], F.slice(new, 1, F.greatest(F.lit(cap + 1) - acc["total"], F.lit(0))))
            return F.struct(F.when(total > cap, head).otherwise(new).alias("readings"), total.alias("total"))

        return F.when(acc["total"] > cap, acc).otherwise(once(product, counted))

    def expansions(token: Column) -> Column:
        start = F.struct(F.array(F.lit("")).alias("readings"), F.lit(0).alias("total"))
        return F.array_distinct(F.aggregate(chars(token), start, grow)["readings"])

    return expansions


def pieces(text: Column, inside: str, opening: str | None = None, wanted=None) -> Column:
    """[(start, piece), ...]: a text's maximal pieces that begin with a character of `opening` (default: inside) and go on with `inside` ones.

    wanted: a test of a piece; texts without any wanted piece cost no places.
    """
    opening = opening or inside

    def test(p: Column) -> Column:
        opens = p.rlike(f"^[{opening}]")
        return opens & wanted(p) if wanted else opens

    def placed(parts: Column) -> Column:
        starts = sums_before(F.transform(parts, lambda p: F.length(p)))
        return F.filter(F.zip_with(starts, parts, lambda at, p: F.struct(at.alias("start"), p.alias("piece"))), lambda x: test(x["piece"]))

    none = F.array().cast("array<struct<start: int, piece: string>>")
    alternating = F.regexp_extract_all(text, F.lit(rf"[{opening}][{inside}]*|[^{opening}]+"), F.lit(0))
    return once(alternating, lambda parts: F.when(F.exists(parts, test), placed(parts)).otherwise(none))


def runs_of(text: Column, inside: str) -> Column:
    """A text's maximal pieces of `inside` characters, in order."""
    return F.regexp_extract_all(text, F.lit(f"[{inside}]+"), F.lit(0))


def alnum_tokens(text: Column) -> Column:
    return pieces(text, ALNUM)


def leet_tokens(text: Column, wanted=None) -> Column:
    return pieces(text, ALNUM + LEET_CLASS, wanted=wanted)


def separator_spans(text: Column, wanted=None) -> Column:
    """Stretches from a letter or digit to the next white space that hold a letter."""
    letters = lambda p: wanted(p) & p.rlike(r"\p{L}") if wanted else p.rlike(r"\p{L}")
    return pieces(text, f"^{SPACE}", ALNUM, letters)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""))


def rule_form(text: Column) -> Column:
    """Lower case, ASCII letters and digits only, runs collapsed to one."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), r"(.)\1+", "$1")


def highlight(text: Column, words: Column, mark: str = "\U0001f534", ascii_only: bool = False) -> Column:
    """Each whole-word, case-insensitive occurrence of words (an array) between two marks; no words: the text itself.

    ascii_only: ASCII letters, digits and _ alone make up words, so that other letters end one, and only A-Z are equal to a-z.
    """
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    flags, edge = ("(?i)", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))") if ascii_only else ("(?iu)", r"\b")  # \b takes in other letters or not, by Java's version
    pattern = F.concat(F.lit(f"{flags}{edge}("), F.array_join(quoted, "|"), F.lit(f"){edge}"))
    return F.when(F.size(words) > 0, F.regexp_replace(text, pattern, F.lit(f"{mark}$1{mark}"))).otherwise(text)
