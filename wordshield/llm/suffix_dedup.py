"""Repeated passages: sampled suffix arrays in a logarithmic family of sorted levels, merge-scanned for long matches.

Every byte string of ``length`` bytes holds ``length - ANCHOR + 1`` starts of ANCHOR-byte substrings; the one with the
least hash (the leftmost of equals) is the string's anchor. Equal strings have their anchors at equal places, so only the
suffixes that begin at anchors, about 1 in 70, are indexed. Neighbouring strings with one anchor form a run; a run's
content is one hash. A level of the family is a table of (suffix, run, n) in the order of the suffixes: suffix is the
first 3 bytes, then 40 bits of the hash of the ANCHOR bytes; run is the run's hash, n its number of occurrences. (Suffixes
that share these 64 bits by chance only cost a look: what is removed rests on suffix and run, or string, together.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, inputs, release, text_keys, written
from .kernels import RangeHash, chunks, joined, mix, sliced

ANCHOR = 64
BLOCK = 16
#: A segment's positions must fit the bits that the hashes leave free for them.
_PLACE_BITS = 20
_SEGMENT = 1 << _PLACE_BITS


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values: running minima of blocks from both ends."""
    n = len(g) - width + 1
    pad = -len(g) % width
    blocks = np.concatenate((g, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(buf: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of a buffer of texts; text k is buf[bounds[k]:bounds[k + 1] - 1]. Starts are relative to the text.

    text, place (start of the run's first string << 16 | number of strings << 8 | bytes from start to the anchor), suffix
    and run.
    """
    hashes = RangeHash(buf)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found: list[tuple[np.ndarray, ...]] = []
    width = length - ANCHOR + 1
    for low in range(0, max(1, len(buf) - length + 1), _SEGMENT - length):
        high = min(len(buf), low + _SEGMENT - 1)
        if high - low < length:
            break
        g = mix((hashes.sums[low + ANCHOR : high + 1] - hashes.sums[low : high + 1 - ANCHOR]) * hashes.down[low : high + 1 - ANCHOR])
        g &= np.uint64(2**64 - _SEGMENT)
        g |= np.arange(len(g), dtype=np.uint64)
        anchor = (_least(g, width) & np.uint64(_SEGMENT - 1)).astype(np.int64) + low
        start = np.arange(low, low + len(anchor))
        text = owner[low : low + len(anchor)]
        inside = start + length <= bounds[text + 1] - 1
        if high < len(buf):
            inside &= start < low + _SEGMENT - length  # the next segment has the others
        start, anchor, text = start[inside], anchor[inside], text[inside]
        if len(start):
            cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1))))
            found.append((text[cut], start[cut], np.diff(np.append(cut, len(start))), anchor[cut]))
        if high == len(buf):
            break
    text, start, strings, anchor = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 4))
    ahead = anchor - start
    run = mix(hashes.of(start, start + strings + length - 1) + (ahead * 256 + strings).astype(np.uint64))
    suffix = hashes.of(anchor, anchor + ANCHOR) >> np.uint64(24)
    for k in range(3):
        suffix |= buf[anchor + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    place = (start - bounds[text]) << 16 | strings << 8 | ahead
    return {"text": text, "place": place, "suffix": (suffix ^ np.uint64(1 << 63)).view(np.int64), "run": run.view(np.int64)}


def suffix_runs(texts: DataFrame, length: int, batches: int) -> DataFrame:
    """(t0, t1, place, suffix, run, batch) for every run of every row of inputs()."""

    def sample(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(rows):
            data = [t.encode() for t in batch.column("text").to_pylist()]
            keys = [batch.column(x).to_numpy() for x in ("t0", "t1")]
            for a, b in chunks(data):
                runs = anchor_runs(*joined(data[a:b]), length)
                owner = runs["text"] + a
                columns = [keys[0][owner], keys[1][owner], runs["place"], runs["suffix"], runs["run"]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["t0", "t1", "place", "suffix", "run"])

    rows = texts.where(F.octet_length("text") >= length).withColumns(text_keys(F.col("text"))).select("text", "t0", "t1")
    made = rows.mapInArrow(sample, "t0 long, t1 long, place long, suffix long, run long")
    return made.withColumn("batch", F.pmod("t0", F.lit(batches)).cast("int"))


class SuffixFamily:
    """Levels of sorted suffix tables of sizes 1, 2, 4, ... batches, at most one of each size."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.matches: list[DataFrame] = []

    @staticmethod
    def _sorted(entries: DataFrame) -> DataFrame:
        summed = entries.groupBy("suffix", "run").agg(F.sum("n").alias("n"))
        return written(summed.sortWithinPartitions("suffix", "run"), "suffixes")

    def add(self, runs: DataFrame) -> None:
        """Sort a new batch's suffixes, scan them against each level for suffixes that both hold, then merge equal sizes."""
        batch = self._sorted(runs.select("suffix", "run", F.lit(1).cast("long").alias("n")))
        new = batch.groupBy("suffix").agg(F.sum("n").alias("n"))
        self.matches.append(written(new.where("n > 1").select("suffix"), "matches"))
        for level in self.levels.values():
            self.matches.append(written(level.select("suffix").distinct().join(new, "suffix").select("suffix"), "matches"))
        size = 1
        while size in self.levels:
            old = self.levels.pop(size)
            merged = self._sorted(old.unionByName(batch))
            drop_written(old)
            drop_written(batch)
            batch, size = merged, 2 * size
        self.levels[size] = batch
        release(runs.sparkSession)

    def repeated(self) -> DataFrame:
        """(suffix, run, n, settled) for the suffixes found at two places or more; n: the run's occurrences in all levels.

        settled: each of the suffix's runs occurs again as a whole, so no single string of them needs a look.
        """
        entries, found = None, None
        for level in self.levels.values():
            entries = level if entries is None else entries.unionByName(level)
        for match in self.matches:
            found = match if found is None else found.unionByName(match)
        counts = entries.join(found.distinct(), "suffix", "left_semi").groupBy("suffix", "run").agg(F.sum("n").alias("n"))
        settled = counts.groupBy("suffix").agg((F.min("n") > 1).alias("settled"))
        return counts.join(settled, "suffix")


def _blocks(rows: DataFrame, length: int) -> DataFrame:
    """The strings of the runs listed with each text (places), in blocks of BLOCK neighbouring distances from the anchor.

    core: what every string of the block holds, at its distance from the anchor, so equal strings are in blocks of equal
    cores; whole: all strings of the block together; strings: the hash of each, in order, the first at `at`.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = [batch.column(x).to_pylist() for x in ("t0", "t1")]
            for k, (text, places) in enumerate(zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())):
                buf = np.frombuffer(text.encode(), np.uint8)
                hashes = RangeHash(buf)
                for low in range(0, len(places), 5000):
                    part = places[low : low + 5000]
                    place = np.array([p["place"] for p in part], np.int64)
                    start, strings, ahead = place >> 16, place >> 8 & 255, place & 255
                    suffix, single = np.array([p["suffix"] for p in part], np.int64).view(np.uint64), np.array([p["single"] for p in part], bool)
                    owner = np.repeat(np.arange(len(part)), strings)
                    at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
                    anchor = (start + ahead)[owner]
                    block = (anchor - at) // BLOCK
                    string = mix(hashes.of(at, at + length) + (anchor - at).astype(np.uint64))
                    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]))))
                    count = np.diff(np.append(first, len(at)))
                    from_, of, near = at[first], owner[first], block[first].astype(np.uint64)
                    open_ = anchor[first] - block[first] * BLOCK  # the core's start
                    core = mix(hashes.of(open_, open_ + (length - BLOCK + 1)) + suffix[of] * np.uint64(3) + near)
                    whole = mix(hashes.of(from_, from_ + count + length - 1) + ((anchor[first] - from_) * 256 + count).astype(np.uint64))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(string.view(np.int64)))
                    columns = [core.view(np.int64), whole.view(np.int64), np.full(len(first), keys[0][k]), np.full(len(first), keys[1][k]), from_, count, single[of]]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["core", "whole", "t0", "t1", "at", "count", "single", "strings"])

    return rows.select("t0", "t1", "text", "places").mapInArrow(spell, "core long, whole long, t0 long, t1 long, at long, count long, single boolean, strings array<long>")


def repeated_spans(texts: DataFrame, length: int, batches: int) -> DataFrame:
    """(t0, t1, spans) for texts of inputs() with repeated strings; spans: [start, end) in bytes, unmerged."""
    runs = written(suffix_runs(texts, length, batches), "runs", ["batch"])
    family = SuffixFamily()
    for b in range(batches):
        family.add(runs.where(F.col("batch") == b))
    marked = written(runs.join(family.repeated(), ["suffix", "run"]).select("t0", "t1", "place", "suffix", "run", "n", "settled"), "marked")
    for df in (*family.levels.values(), *family.matches, runs):
        drop_written(df)
    start, strings = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    whole = marked.where("n > 1").select("t0", "t1", start.alias("start"), (start + strings + (length - 1)).alias("end"))

    # The rest lies at the ends of matches: a run that occurs once, whose suffix occurs again. The strings of such
    # suffixes are compared, by blocks and, where a block's core is found again but not the block, one by one; runs that
    # occur again take part once, for the others to be found in.
    first = F.min(F.struct("t0", "t1", "place")).alias("p")
    open_runs = marked.where("not settled").groupBy("suffix", "run").agg(first, F.max(F.col("n") == 1).alias("single"))
    listed = open_runs.groupBy("p.t0", "p.t1").agg(F.collect_list(F.struct("p.place", "suffix", "single")).alias("places"))
    listed = written(listed, "listed")
    sources = texts.withColumns(text_keys(F.col("text"))).join(listed.select("t0", "t1"), ["t0", "t1"], "left_semi").groupBy("t0", "t1").agg(F.first("text").alias("text"))
    blocks = written(_blocks(sources.join(listed, ["t0", "t1"]), length), "blocks")
    counts = blocks.groupBy("core", "whole").agg(F.count("*").alias("n"), F.max("single").alias("any"))
    cores = counts.groupBy("core").agg(F.sum("n").alias("held"), F.min(F.when(F.col("any"), F.col("n"))).alias("least"))
    judged = counts.join(cores.where("held > 1 and least is not null"), "core").select("core", "whole", (F.col("n") > 1).alias("again"), (F.col("least") == 1).alias("open"))
    judged = written(judged, "judged")
    known = blocks.join(judged.where("again"), ["core", "whole"]).where("single")
    parts = known.select("t0", "t1", F.col("at").alias("start"), (F.col("at") + F.col("count") + (length - 1)).alias("end"))
    wanted = blocks.join(judged.where("open"), ["core", "whole"])
    strings = written(wanted.select("core", "t0", "t1", "at", (F.col("single") & ~F.col("again")).alias("single"), F.posexplode("strings").alias("k", "string")), "strings")
    again = strings.groupBy("core", "string").agg(F.count("*").alias("n")).where("n > 1").select("core", "string")
    some = strings.where("single").join(again, ["core", "string"]).select("t0", "t1", (F.col("at") + F.col("k")).alias("start"), (F.col("at") + F.col("k") + length).alias("end"))
    parts = parts.union(some)
    spans = whole.union(parts).groupBy("t0", "t1").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "spans")
    for df in (marked, listed, blocks, judged, strings):
        drop_written(df)
    release(texts.sparkSession)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, batches: int = 3, carry: bool = False) -> DataFrame:
    """(id, n_bytes, kept, spans[, kept_text, row]) for every row: the UTF-8 bytes that are left, and the removed [start, end) spans, merged.

    A byte goes if a string of `length` bytes over it also starts anywhere else, in the same row or another; equal rows
    are elsewhere to each other. Strings are judged on the input. A null text is empty, shorter texts lose nothing.
    kept is binary, since a span may end inside a character. carry adds kept as text, without the bytes of cut characters,
    and the whole input row as a struct.

    Each of `batches` parts of the table is sorted and scanned against the family's levels. Work and tables grow with
    the number of bytes; a passage in many texts costs rows in proportion to its occurrences, split over tasks.
    """
    texts = inputs(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    spans = repeated_spans(texts, length, batches)
    if carry:
        texts = inputs(docs, id_col, text_col, carry=True)
    more = [f"kept_text string, row {texts.schema['row'].dataType.simpleString()}"] if carry else []

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(rows):
            sizes, kept, removed = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode()
                merged: list[dict[str, int]] = []
                left, at = [], 0
                for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                    if merged and s <= merged[-1]["end"]:
                        merged[-1]["end"] = max(e, merged[-1]["end"])
                    else:
                        merged.append({"start": s, "end": e})
                for m in merged:
                    left.append(data[at : m["start"]])
                    at = m["end"]
                sizes.append(len(data))
                kept.append(b"".join([*left, data[at:]]))
                removed.append(merged)
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names = ["id", "n_bytes", "kept", "spans"]
            if carry:
                columns += [pa.array([k.decode(errors="ignore") for k in kept], pa.string()), batch.column("row")]
                names += ["kept_text", "row"]
            yield pa.RecordBatch.from_arrays(columns, names)

    keyed = texts.withColumns(text_keys(F.col("text")))
    schema = ", ".join([f"id {kind}, n_bytes long, kept binary, spans array<struct<start: long, end: long>>", *more])
    return keyed.join(spans.hint("shuffle_hash"), ["t0", "t1"], "left").drop("t0", "t1").mapInArrow(cut, schema)
