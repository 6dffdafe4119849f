"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents, in DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import inputs, small, text_keys, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: the ASCII characters that are neither digits nor letters.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; other letters stay as they are."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAPS), lambda w: w != "")


def item_windows(items: DataFrame, item_col: str, text_col: str, length: int) -> DataFrame:
    """(window, w0, w1, item): runs of `length` item words, or a shorter item's words, with the window's 128-bit key."""
    words = items.select(F.col(item_col).cast("string").alias("item"), item_words(F.coalesce(text_col, F.lit(""))).alias("words")).where("size(words) > 0")
    last = F.greatest(F.size("words") - length, F.lit(0))
    windows = words.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("words", k + 1, length))).alias("window"))
    return windows.select("window", F.xxhash64("window").alias("w0"), F.xxhash64(F.lit(20_011), "window").alias("w1"), "item")


def _shingle(words: str, place: Column, width: int) -> Column:
    """64-bit key of `width` words from a place on (from 0); a key only proposes candidates."""
    return F.xxhash64(F.lit(width), *(F.element_at(words, place + (k + 1)) for k in range(width)))


def _document_shingles(words: DataFrame, width: int) -> DataFrame:
    """Every place of every document's words where `width` words begin, with the shingle's key."""
    placed = words.where(F.size("words") >= width).select("*", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("place"))
    return placed.withColumn("shingle", _shingle("words", F.col("place"), width))


def contaminated_spans(docs: DataFrame, windows: DataFrame, shingle_words: int = 3, broadcast_bytes: int = 32_000_000) -> DataFrame:
    """(t0, t1, start, end, w0, w1), in words, for every place of a window in the texts of inputs(); windows: (window, w0, w1), each once.

    A window's tokens are its shingles (of shingle_words words, or all words of a shorter window), ordered by their
    frequency in all documents. Containment is wanted in full, so the prefix that must be joined is one token: the rarest.
    A join partner's place fixes the window's: it must lie within the document (length and positional bound) and its
    words must equal the window's (verification).

    Windows are broadcast only while they measure at most broadcast_bytes; beyond that the same tokens are joined by a
    shuffle that carries places, not words: documents' shingles are counted before they meet the windows', and
    candidates meet their documents again by text key.
    """
    texts = docs.withColumns(text_keys(F.col("text")))
    words = texts.select("t0", "t1", item_words(F.col("text")).alias("words"))
    windows = windows.withColumn("width", F.least(F.size("window"), F.lit(shingle_words)))
    # a window's row, and for each of its shingles a key, a place and a count
    narrow = small(windows.withColumn("joined", F.array_join("window", " ")), broadcast_bytes, 600, F.col("joined"))
    hint = F.broadcast if narrow else (lambda df: df)
    places = F.explode(F.sequence(F.lit(0), F.size("window") - F.col("width"))).alias("at")
    present = sorted(r["width"] for r in windows.select("width").distinct().collect())  # at most shingle_words values
    hits = []
    for width in present:
        own = windows.where(F.col("width") == width)
        tokens = own.select("w0", "w1", places, "window").withColumn("shingle", _shingle("window", F.col("at"), width)).drop("window")
        wanted = tokens.select("shingle").distinct()
        seen = _document_shingles(words, width).select("shingle")
        seen = seen.join(F.broadcast(wanted), "shingle").groupBy("shingle").agg(F.count("*").alias("n")) if narrow else seen.groupBy("shingle").agg(F.count("*").alias("n")).join(wanted, "shingle")
        # a window with a token that no document has can't occur: its least frequency is 0
        counted = tokens.join(seen, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        prefix = counted.groupBy("w0", "w1").agg(F.min(F.struct("n", "at", "shingle")).alias("token")).where("token.n > 0")
        rarest = own.join(hint(prefix), ["w0", "w1"]).select("w0", "w1", "window", F.col("token.at").alias("at"), F.col("token.shingle").alias("shingle"))
        rarest = written(rarest, "prefix")
        start = F.col("place") - F.col("at")
        bounds = (start >= 0) & (start + F.size("window") <= F.size("words"))
        if narrow:
            pairs = _document_shingles(words, width).join(F.broadcast(rarest), "shingle").where(bounds)
        else:
            found = _document_shingles(words, width).select("t0", "t1", F.size("words").alias("n_words"), "place", "shingle").join(rarest.select("shingle", "at", F.size("window").alias("n")), "shingle")
            found = found.where("place >= at and place - at + n <= n_words").select("t0", "t1", "shingle", "place").distinct()
            pairs = words.dropDuplicates(["t0", "t1"]).join(found, ["t0", "t1"]).join(rarest, "shingle").where(bounds)
        pairs = pairs.where(F.slice("words", start + 1, F.size("window")) == F.col("window"))
        hits.append(pairs.select("t0", "t1", start.alias("start"), (start + F.size("window")).alias("end"), "w0", "w1"))
    if not hits:
        return texts.select("t0", "t1", F.lit(0).alias("start"), F.lit(0).alias("end"), F.col("t0").alias("w0"), F.col("t1").alias("w1")).where("false")
    return reduce(DataFrame.union, hits).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 13, share: int = 20) -> DataFrame:
    """(id, n_words, n_hit, items, hits, contaminated, t0, t1) for every row; t0 and t1 are the text's key.

    A document word is hit if it lies in an occurrence of a window: `length` consecutive words of an item, or all words
    of a shorter one. contaminated: a word is hit, and share * n_hit >= n_words. items: the ids, as sorted strings, of
    items with occurring windows. A null or empty text has no words and is clean; an empty benchmark hits nothing;
    repeated items count once, equal rows each get a row; null item ids are left out of items, their windows are not.
    hits: the places of windows as (start, end) in words.
    """
    texts = inputs(docs, id_col, text_col)
    held = item_windows(items, item_col, item_text_col, length)
    windows = written(held.dropDuplicates(["w0", "w1"]).select("window", "w0", "w1"), "windows")
    holders = written(held.select("w0", "w1", "item").where("item is not null").distinct(), "holders")
    hits = written(contaminated_spans(texts, windows), "hits")
    spans = hits.groupBy("t0", "t1").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, h: F.struct((acc["n"] + F.greatest(h["end"] - F.greatest(h["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], h["end"]).alias("upto")),
    )["n"]
    # the items of a window are looked up once for each text that has it
    side = F.broadcast(holders) if small(holders, 32_000_000, 64, F.col("item")) else holders
    owned = hits.select("t0", "t1", "w0", "w1").distinct().join(side, ["w0", "w1"]).groupBy("t0", "t1").agg(F.array_sort(F.collect_set("item")).alias("held"))
    found = spans.select("t0", "t1", covered.cast("long").alias("hit"), "hits").join(owned, ["t0", "t1"], "left")
    rows = texts.withColumns(text_keys(F.col("text"))).select("id", "t0", "t1", F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, ["t0", "t1"], "left").withColumn("n_hit", F.coalesce("hit", F.lit(0).cast("long")))
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return out.select("id", "n_words", "n_hit", F.coalesce("held", F.array().cast("array<string>")).alias("items"), "hits", dirty.alias("contaminated"), "t0", "t1")
