"""Document fingerprints by Order MinHash: the least occurrence-numbered k-mers, in text order, hashed as tuples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import inputs, text_keys, written
from .kernels import mix, sliced

_ODD = np.uint64(0x9E3779B97F4A7C15)


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k code points, pieces of doubled length joined: log(k) steps instead of k."""
    piece, width, out, done = mix(codes.astype(np.uint64) + _ODD), 1, None, 0
    while True:
        if k & width:
            if out is None:
                out = piece
            else:  # what is done comes first
                n = len(codes) - done - width + 1
                out = mix(out[: max(n, 0)] * _ODD + piece[done : done + max(n, 0)])
            done += width
        width *= 2
        if width > k:
            return out
        half = width // 2
        n = max(len(codes) - width + 1, 0)
        piece = mix(piece[:n] * _ODD + piece[half : half + n])


def occurrence_numbers(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each k-mer, how many equal ones its text has before it."""
    out = np.zeros(len(hashes), np.uint64)
    key = hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):  # only k-mers that come again need their order
        place = np.minimum(np.searchsorted(again, key), len(again) - 1)
        some = np.flatnonzero(again[place] == key)
        by_key = some[np.argsort(key[some], kind="stable")]
        new = np.flatnonzero(np.concatenate(([True], key[by_key[1:]] != key[by_key[:-1]])))
        sizes = np.diff(np.append(new, len(by_key)))
        out[by_key] = np.arange(len(by_key)) - np.repeat(new, sizes)
    return out


def fingerprints(texts: list[str], k: int, least: int, parts: int) -> np.ndarray:
    """A row of `parts` 32-bit values for each text; 0 stands for a part without k-mers.

    parts is a power of two. Every occurrence-numbered k-mer has one 64-bit hash; the hashes' range is cut into equal parts,
    and the `least` k-mers of lowest hash in each part (all of a part's, if fewer), put in text order, are its tuple. A text
    of fewer than k characters, but not none, is one k-mer.
    """
    out = np.zeros((len(texts), parts), np.uint32)
    first = 0
    while first < len(texts):  # blocks that stay in the CPU's cache; a longer text is a block of its own
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= 60_000:
            size += len(texts[last])
            last += 1
        out[first:last] = _block(texts[first:last], k, least, parts)
        first = last
    return out


def _block(texts: list[str], k: int, least: int, parts: int) -> np.ndarray:
    out = np.zeros(len(texts) * parts, np.uint32)
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum(lengths) - lengths
    number = np.maximum(lengths - k + 1, 0)
    owner = np.repeat(np.arange(len(texts)), number)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)  # places within the texts
    whole = kmer_hashes(codes, k)
    hashes = whole[starts[owner] + at] if len(whole) else np.zeros(0, np.uint64)
    short = np.flatnonzero((lengths < k) & (lengths > 0))
    if len(short):
        ends = np.array([int.from_bytes(hashlib.blake2b(texts[x].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in short.tolist()], np.uint64)
        owner, at, hashes = np.append(owner, short), np.append(at, np.zeros(len(short), np.int64)), np.append(hashes, ends)
    if not len(owner):
        return out.reshape(len(texts), parts)
    values = mix(hashes * _ODD + occurrence_numbers(hashes, owner))
    bits = parts.bit_length() - 1
    part = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    group = owner * parts + part
    low = (values << np.uint64(bits)) >> np.uint64(32)  # the value's bits below its part
    # only low values can be among a part's least; a text in which a part then has too few takes all of its own
    share = np.minimum(8.0 * least * parts / np.maximum(number, 1), 1.0)
    kept = low < (share * 2.0**32).astype(np.uint64)[owner]
    lacking = (np.bincount(group[kept], minlength=len(out)).reshape(len(texts), parts) < least).any(axis=1)
    kept |= lacking[owner]
    owner, at, values, group, low = owner[kept], at[kept], values[kept], group[kept], low[kept]
    order = np.argsort((group.astype(np.uint64) << np.uint64(32)) | low, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], group[order[1:]] != group[order[:-1]])))
    sizes = np.minimum(np.diff(np.append(new, len(order))), least)
    chosen = order[new + np.minimum(np.arange(least)[:, None], sizes - 1)]  # least x groups; a group of fewer repeats its last
    chosen = np.take_along_axis(chosen, np.argsort(at[chosen], axis=0, kind="stable"), 0)
    tuples = np.full(len(new), 0x1234_5678, np.uint64)
    for j in range(least):
        repeat = chosen[j] == chosen[j - 1] if j else np.zeros(len(new), bool)
        tuples = np.where(repeat, tuples, mix(tuples * _ODD + values[chosen[j]]))
    out[group[order[new]]] = np.maximum((tuples >> np.uint64(32)).astype(np.uint32), 1)
    return out.reshape(len(texts), parts)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the parts that either of two fingerprints fills, the share with equal tuples; two empty ones are alike."""
    filled = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    return np.where(filled > 0, same / np.maximum(filled, 1), 1.0)


def as_text(row: np.ndarray) -> str:
    return row.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by the first as many characters of following, or all if it has fewer."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(texts: list[str], own: np.ndarray, k: int, least: int, parts: int) -> list[list]:
    """Result columns of all texts but the last, each compared with the one after it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    other = fingerprints(changed, k, least, parts)
    digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    return [[len(t) for t in texts[:-1]], digests, [as_text(x) for x in own[:-1]], [as_text(x) for x in other], likeness(own[:-1], other), likeness(own[:-1], own[1:])]


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 12, least: int = 2, parts: int = 64) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    A fingerprint is a hex string of `parts` tuple hashes (see fingerprints()). It depends on the order of the k-mers, not
    only on which there are, so it follows edit distance: the chance that two texts share a tuple is that their `least`
    lowest k-mers of a part are the same ones in the same order. Each text is compared with its edited text (see edited())
    and with the next document's, by ascending id; after the last comes the first. Equal ids follow each other by their
    texts' hashes, null ids come first; a null text is empty. A single row is its own next one.

    Texts cross one shuffle, into ranges of ids (with the texts' hashes and a row number behind them, so one id with very
    many rows fills several ranges). Each task streams its range and keeps one row back; the first and last rows of the ranges,
    two a task, meet in a join at the end.
    """
    texts = inputs(docs, id_col, text_col).withColumns(text_keys(F.coalesce("text", F.lit("")))).withColumn("nth", F.monotonically_increasing_id())
    ranged = texts.repartitionByRange(F.asc_nulls_first("id"), "t0", "t1", "nth").sortWithinPartitions(F.asc_nulls_first("id"), "t0", "t1", "nth")
    ranged = ranged.select(F.spark_partition_id().alias("range"), "id", "text")
    kind = ranged.schema["id"].dataType.simpleString()
    schema = f"range int, edge int, id {kind}, text string, {_RESULT}"
    names = ["range", "edge", "id", "text", *(x.split()[0] for x in _RESULT.split(", "))]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of(range_: int, edge: int | None, ids: pa.Array, texts: list[str | None], columns: list[list] | None) -> pa.RecordBatch:
        n = len(ids)
        columns = [[None] * n] * 6 if columns is None else columns
        head = [pa.array([range_] * n, pa.int32()), pa.array([edge] * n, pa.int32()), ids, pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*head, *(pa.array(c, t) for c, t in zip(columns, types))], names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row kept back: its id, text and fingerprint
        for batch in sliced(batches, 256):
            if not batch.num_rows:
                continue
            here, found = batch.column("range")[0].as_py(), batch.column("text").to_pylist()
            own = fingerprints(found, k, least, parts)
            ids = batch.column("id")
            if last is None:
                yield batch_of(here, 0, ids.slice(0, 1), found[:1], None)
            else:
                ids, found, own = pa.concat_arrays([last[0], ids]), [last[1], *found], np.concatenate((last[2], own))
            if len(found) > 1:
                yield batch_of(here, None, ids.slice(0, len(found) - 1), [None] * (len(found) - 1), _compared(found, own, k, least, parts))
            last = ids.slice(len(found) - 1), found[-1], own[-1:]
        if last is not None:
            yield batch_of(here, 1, last[0], [last[1]], None)

    made = written(ranged.mapInArrow(walk, schema), "fingerprints")
    heads = made.where("edge = 0").select(F.col("range").alias("of"), F.col("text").alias("after"))
    tails = made.where("edge = 1").select("range", "id", "text")
    follow = Window.orderBy("range")  # a row a range
    ranges = tails.select("range").withColumn("of", F.coalesce(F.lead("range").over(follow), F.min("range").over(Window.partitionBy())))
    met = tails.join(ranges, "range").join(heads, "of").select("id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            rows = []
            for a, b in zip(batch.column("text").to_pylist(), batch.column("after").to_pylist()):
                rows.append([c[0] for c in _compared([a, b], fingerprints([a, b], k, least, parts), k, least, parts)])
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["id", *names[4:]])

    closed = written(met.mapInArrow(close, f"id {kind}, {_RESULT}"), "fingerprints")
    return made.where("edge is null").select("id", *names[4:]).unionByName(closed)

