"""Ranked lexical search: document shards of postings with precomputed integer impacts, searched term at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, inputs, written
from .kernels import LOWER, RangeHash, chunks, joined, sliced

#: Bytes that no term has; all bytes of characters beyond ASCII belong to terms.
GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of a buffer that ends in a gap: maximal runs of ASCII letters, digits and characters beyond ASCII."""
    gap = np.concatenate(([True], GAPS[buf]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def hashed_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms (A-Z lower-cased) of texts in order, and each one's text."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for a, b in chunks(texts):
        buf, at = joined(texts[a:b])
        buf = LOWER[buf]
        start, end = term_bounds(buf)
        hashes.append(RangeHash(buf).of(start, end))
        owners.append((np.searchsorted(at, start, "right") - 1 + a).astype(np.int32))
    return np.concatenate(hashes), np.concatenate(owners)


def corpus_size(texts: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all documents' terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in sliced(batches):
            found = [t.encode() for t in batch.column("text").to_pylist()]
            for a, b in chunks(found):
                buf, at = joined(found[a:b])
                per_text = np.diff(np.searchsorted(term_bounds(buf)[0], at))
                docs, terms = docs + int(np.count_nonzero(per_text)), terms + int(per_text.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])

    row = texts.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


@dataclass(frozen=True)
class Index:
    """shards: a written table with a row for each shard of documents, its postings in compressed sparse rows by term.

    ids: the shard's documents, ascending; terms: hashes, ascending; dfs: documents of each; docs and impacts: for each term in
    turn its documents' places in ids (ascending) and impacts, 32-bit integers.
    """

    shards: DataFrame
    n_docs: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20) -> Index:
    """Index every row of docs in shards of about shard_bytes of text, within its partition: no shuffle.

    A posting's impact is (10**9 * tf) div (1000 * tf + 20 * m), m = 50 + (50 * n * n_docs) div n_terms, n the document's
    terms with repeats; n_docs and n_terms are counted over the corpus first. A text without terms (null, empty) has no
    postings. Equal rows are documents of their own. Terms are known by 64-bit hashes. A task holds one shard at a time.
    """
    texts = inputs(docs, id_col, text_col)
    n_docs, n_terms = corpus_size(texts)
    kind = texts.schema["id"].dataType.simpleString()

    def shard(ids: list, found: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
        named = pa.array(ids, id_type)
        order = pc.sort_indices(named, null_placement="at_end")
        hashes, owner = hashed_terms([found[k] for k in order.to_pylist()])
        lengths = np.bincount(owner, minlength=len(ids))
        distinct, back = np.unique(lengths, return_inverse=True)
        m = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in distinct.tolist()], np.int64)[back]
        by_term = np.argsort(hashes, kind="stable")  # documents stay in order within a term
        hashes, owner = hashes[by_term].view(np.int64), owner[by_term]
        new_term = np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)]
        new = new_term.copy()
        new[1:] |= owner[1:] != owner[:-1]
        first = np.flatnonzero(new)
        tf = np.diff(np.append(first, len(hashes)))
        of = owner[first]
        impacts = (10**9 * tf) // (1000 * tf + 20 * m[of])
        starts = np.flatnonzero(new_term[first])
        terms, dfs = hashes[first][starts], np.diff(np.append(starts, len(first)))
        by_value = np.argsort(terms)  # as signed values
        at = np.repeat(starts[by_value], dfs[by_value]) + _within(dfs[by_value])
        one = lambda x, t: pa.array([x], pa.list_(t))
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), named.take(order)), one(terms[by_value], pa.int64()), one(dfs[by_value].astype(np.int32), pa.int32())]
        columns += [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (of[at], impacts[at])]
        return pa.RecordBatch.from_arrays(columns, ["ids", "terms", "dfs", "docs", "impacts"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, size, id_type = [], [], 0, None
        for batch in sliced(batches):
            id_type = batch.column("id").type
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                encoded = text.encode()
                if found and size + len(encoded) > shard_bytes:
                    yield shard(ids, found, id_type)
                    ids, found, size = [], [], 0
                ids.append(name)
                found.append(encoded)
                size += len(encoded)
        if found:
            yield shard(ids, found, id_type)

    made = texts.mapInArrow(index, f"ids array<{kind}>, terms array<long>, dfs array<int>, docs binary, impacts binary")
    return Index(written(made, "postings"), n_docs)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each of sizes in turn."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def asked_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term) for each distinct term of each item; rows of one id are one item."""
    texts = inputs(items, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes, owner = hashed_terms([t.encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array(hashes.view(np.int64))], ["item", "term"])

    return texts.mapInArrow(read, f"item {kind}, term long").distinct()


def top_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal scores at the edge, those that come first."""
    if len(scores) > k:
        edge = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]]
        if edge > 0:
            above = np.flatnonzero(scores > edge)
            return np.concatenate((above, np.flatnonzero(scores == edge)[: k - len(above)]))
    return np.flatnonzero(scores > 0)


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows (item, score, id) of each item: highest score first, equal ones by id."""
    order = pc.sort_indices(rows, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end")
    rows = rows.take(order)
    item = rows.column("item").to_numpy()
    new = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))[: len(item)])
    return rows.filter(pa.array(_within(np.diff(np.append(new, len(item)))) < k))


def _searched(index: Index, asked: pa.Table, item_type: str, k: int, held_rows: int = 300_000) -> DataFrame:
    """(item, id, score): the k best documents of each task's shards for each item of asked (item, term, w), a bounded table."""
    asked = asked.sort_by([("number", "ascending")]).combine_chunks()
    number = asked.column("number").to_numpy()
    edges = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True]))) if len(number) else np.zeros(1, np.int64)
    names = asked.column("item").combine_chunks().take(pa.array(edges[:-1]))
    terms, at = np.unique(asked.column("term").to_numpy(), return_inverse=True)
    weights = asked.column("w").to_numpy()
    kind = index.shards.schema["ids"].dataType.elementType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for r in range(batch.num_rows):
                ids, have, dfs = (batch.column(c).slice(r, 1).flatten() for c in ("ids", "terms", "dfs"))
                have, dfs = have.to_numpy(), dfs.to_numpy()
                docs, impacts = (np.frombuffer(batch.column(c)[r].as_buffer(), "<i4") for c in ("docs", "impacts"))
                ends = np.cumsum(dfs, dtype=np.int64)
                place = np.minimum(np.searchsorted(have, terms), max(len(have) - 1, 0))
                there = have[place] == terms if len(have) else np.zeros(len(terms), bool)
                scores = np.zeros(len(ids), np.int64)
                for q, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    scores[:] = 0
                    for j in range(a, b):
                        if there[at[j]]:
                            t = place[at[j]]
                            own = slice(int(ends[t]) - int(dfs[t]), int(ends[t]))
                            scores[docs[own]] += impacts[own].astype(np.int64) * weights[j]
                    best = top_places(scores, k)
                    if len(best):
                        held.append(pa.table({"item": pa.array(np.full(len(best), q, np.int32)), "score": pa.array(scores[best]), "id": ids.take(pa.array(best))}))
                        rows += len(best)
                if rows > held_rows:
                    held = [_best(pa.concat_tables(held), k)]
                    rows = max(0, len(held[0]) - len(edges) * k)  # of what further shards add
        if held:
            out = _best(pa.concat_tables(held), k).combine_chunks()
            for x in out.to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([names.take(x.column("item")), x.column("id"), x.column("score")], ["item", "id", "score"])

    return index.shards.mapInArrow(search, f"item {item_type}, id {kind}, score long")


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block_rows: int = 500_000, salts: int = 64) -> DataFrame:
    """Written table (item, rank, id, score): each item's k best documents with a score above 0, by score, then ascending id (null last).

    A term's weight is floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))), df over the whole corpus; a document's score sums
    weight times impact over the item's distinct terms. Items without terms give no rows; rows of one item id are one item.
    Each task walks its shards with one accumulator a document of a shard and keeps k documents an item; these meet over
    `salts` groups an item first. Items go out to the tasks in blocks of about block_rows (item, term) rows, so what a task is
    sent is bounded however many items there are.
    """
    asked = written(asked_terms(items, id_col, text_col), "asked")
    listed = index.shards.select(F.inline(F.arrays_zip("terms", "dfs"))).select(F.col("terms").alias("term"), F.col("dfs").alias("df"))
    known = listed.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.ln(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(known, "term").select("item", "term", w.alias("w"), F.xxhash64("item").alias("number"))
    weighted = written(weighted, "weighted")
    blocks = max(1, -(-weighted.count() // block_rows))
    item_type, out = weighted.schema["item"].dataType.simpleString(), []
    for b in range(blocks):
        block = weighted.where(F.pmod("number", F.lit(blocks)) == b).toArrow()  # about block_rows rows
        out.append(_searched(index, block, item_type, k))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("id")]
    some = found.withColumn("salt", F.spark_partition_id() % salts)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    best = written(best.select("item", "rank", "id", "score"), "ranked")
    drop_written(asked)
    drop_written(weighted)
    return best


def drop_index(index: Index) -> None:
    drop_written(index.shards)
