"""Cross-tokenizer alignment: the end events of two tokenizers' tokens, swept by document into groups and links."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, inputs, release, text_keys, written
from .kernels import chunks, sliced

#: A blank between two characters that aren't white space: tokens of neither tokenizer go over it (see Vocabulary.cuts).
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Ends of tokens with an offset in one window of this many bytes travel in one row.
WINDOW = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """encode: ids of a blank and a text; bytes: what each id stands for; cuts: whether tokens never go over a lone blank, so that pieces between such blanks are encoded alike wherever they stand."""

    encode: Callable[[str], np.ndarray]
    bytes: list[bytes]
    cuts: bool


def byte_level(ranks_path: str, pattern: str, tokenizer_path: str) -> Vocabulary:
    """A byte-level BPE by its ranks; special tokens' strings are plain text. Its pattern begins a new piece at each lone blank. Texts that it can't take go to the tokenizer file."""
    from .packing import encoder, read_ranks

    ranks = read_ranks(ranks_path)
    one = encoder(ranks_path, pattern, None, tokenizer_path)
    return Vocabulary(lambda text: one(" " + text).astype(np.int64), sorted(ranks, key=ranks.get), True)


def sentence_pieces(model_path: str) -> Vocabulary:
    """A sentencepiece model that puts a blank before each text; no piece of it may hold a blank behind another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    cuts = not any(" " in t.lstrip(b" ").decode(errors="replace") for t in table)
    return Vocabulary(lambda text: np.array(model.encode(text, num_threads=1), np.int64), table, cuts)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of `size` numbers for each in turn."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Tokens:
    """Token ids of texts by two vocabularies. Where both cut at lone blanks, each distinct piece is encoded once, until about `held` tokens are kept."""

    def __init__(self, a: Vocabulary, b: Vocabulary, piece_chars: int = 100_000, held: int = 3_000_000):
        self.sides, self.piece_chars, self.held = (a, b), piece_chars, held
        self.sizes = [np.array([len(x) for x in v.bytes], np.int64) for v in self.sides]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.known = [(np.zeros(0, np.int32), np.zeros(0, np.int64))] * 2  # ids of all pieces by number, and how many each has

    def _read(self, pieces: list[str]) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """Both sides' ids of pieces, joined by blanks, and how many tokens each piece has; a piece whose bytes don't come back from both has none."""
        joined = " ".join(pieces)
        want = b" " + joined.encode("utf-8", "surrogatepass")
        bounds = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in pieces])
        out = []
        for v, sizes in zip(self.sides, self.sizes):
            ids = v.encode(joined)
            ends = np.cumsum(sizes[ids])
            at = np.minimum(np.searchsorted(ends, bounds), max(len(ends) - 1, 0))
            if not len(ends) or (ends[at] != bounds).any() or b"".join(map(v.bytes.__getitem__, ids.tolist())) != want:
                break
            out.append(([ids], np.diff(at + 1, prepend=0)))
        if len(out) == 2:
            return out
        if len(pieces) == 1:
            return [([], np.zeros(1, np.int64))] * 2
        half = len(pieces) // 2
        return [(x[0] + y[0], np.concatenate((x[1], y[1]))) for x, y in zip(self._read(pieces[:half]), self._read(pieces[half:]))]

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side, all texts' ids in order and how many each text has: none without text, or where the bytes don't come back."""
        cut = all(v.cuts for v in self.sides)
        if len(self.known[1][0]) > self.held:
            self._forget()
        number, before = self.number, len(self.number)
        pieces = [[number.setdefault(p, len(number)) for p in (_CUT.split(t) if cut else [t])] if t else [] for t in texts]
        distinct, ids, counts = list(islice(number, before, None)), ([], []), ([], [])
        first = 0
        while first < len(distinct):
            last, size = first + 1, len(distinct[first])
            while last < len(distinct) and cut and size + len(distinct[last]) <= self.piece_chars:
                size += len(distinct[last])
                last += 1
            for side, (found, n) in enumerate(self._read(distinct[first:last])):
                ids[side].extend(found)
                counts[side].append(n)
            first = last
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
        index = np.array([k for p in pieces for k in p], np.int64)
        out = []
        for side in range(2):
            all_, n = self.known[side]
            if distinct:
                all_, n = np.concatenate([all_, *(x.astype(np.int32) for x in ids[side])]), np.concatenate([n, *counts[side]])
            self.known[side] = all_, n
            own = n[index]
            lacking = np.bincount(owner[own == 0], minlength=len(texts)) > 0
            own = np.where(lacking[owner], 0, own)
            total = np.bincount(owner, own, minlength=len(texts)).astype(np.int64)
            out.append((all_[_spread((np.cumsum(n) - n)[index], own)], total))
        return out


_EVENTS = "side int, win long, payload binary"
#: Compression of events and links on their way.
LEVEL = 3


def packed_events(first: int, steps: np.ndarray, ids: np.ndarray, id_type: str, tool: zstandard.ZstdCompressor) -> bytes:
    """The offset of the first end in its window, the steps from there to the others, in bytes if they are short, and the tokens' ids."""
    short = len(steps) == 0 or int(steps.max()) < 256
    head = np.array([first], "<u4").tobytes() + bytes([short])
    return tool.compress(head + steps.astype("u1" if short else "<u2").tobytes() + ids.astype(id_type).tobytes())


def unpacked_events(payload: bytes, id_type: str, tool: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """Offsets within the window, and ids."""
    raw = tool.decompress(payload)
    width, size = (1 if raw[4] else 2), np.dtype(id_type).itemsize
    n = (len(raw) - 5 + width) // (width + size)
    steps = np.frombuffer(raw, "u1" if width == 1 else "<u2", n - 1, 5)
    ends = np.cumsum(np.concatenate((np.frombuffer(raw, "<u4", 1), steps)), dtype=np.int64)
    return ends, np.frombuffer(raw, id_type, n, 5 + width * (n - 1)).astype(np.int64)


def end_events(texts: DataFrame, vocabularies: Callable[[], tuple[Vocabulary, Vocabulary]], window: int = WINDOW) -> DataFrame:
    """(id, t0, t1, side, win, payload): the ends of all tokens of A (side 0) and B (side 1), a row for each window of byte offsets.

    payload: see packed_events(). A text without tokens is one row of side -1.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pack = Tokens(*vocabularies()), zstandard.ZstdCompressor(level=LEVEL)
        types = [_id_type(len(v.bytes)) for v in tokens.sides]
        for batch in sliced(batches):
            found = batch.column("text").to_pylist()
            for low, high in chunks([t.encode("utf-8", "surrogatepass") for t in found], 1_000_000):
                rows: list[tuple[int, int, int, bytes]] = []
                for side, ((ids, counts), sizes) in enumerate(zip(tokens.of(found[low:high]), tokens.sizes)):
                    steps, upto = sizes[ids], np.cumsum(counts).tolist()
                    for k, (b, n) in enumerate(zip(upto, counts.tolist())):
                        if n == 0:
                            if side == 0:
                                rows.append((low + k, -1, 0, b""))
                            continue
                        a = b - n
                        ends = np.cumsum(steps[a:b], dtype=np.int64)
                        edges = (np.flatnonzero(np.diff(ends // window)) + 1).tolist() if ends[-1] >= window else []
                        for x, y in zip([0, *edges], [*edges, n]):
                            first = int(ends[x]) // window
                            rows.append((low + k, side, first, packed_events(int(ends[x]) - first * window, steps[a + x + 1 : a + y], ids[a + x : a + y], types[side], pack)))
                owners, *columns = (pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary())))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owners) for c in ("id", "t0", "t1")), *columns], ["id", "t0", "t1", "side", "win", "payload"])

    return texts.mapInArrow(read, f"id {kind}, t0 long, t1 long, {_EVENTS}")


def _id_type(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


@dataclass
class Document:
    """What is known of a document: its key, copies, totals so far, the ends and ids since the last common end, that end, and the digest of the groups that are closed."""

    key: list
    first: tuple
    copies: int = 0
    seen: tuple | None = None
    open: list = field(default_factory=lambda: [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2)
    upto: int = 0
    totals: list = field(default_factory=lambda: [0, 0, 0, 0])
    digest: object = field(default_factory=hashlib.sha256)
    pairs: list = field(default_factory=list)

    def take(self, new: list[tuple[np.ndarray, np.ndarray]]) -> tuple | None:
        """The next ends and ids of both sides, all beyond those before; what lies between the last common end before and the one now, if there is one: ends from there, and ids."""
        if any(len(o[0]) for o in self.open):
            new = [(np.concatenate((o[0], n[0])), np.concatenate((o[1], n[1]))) for o, n in zip(self.open, new)]
        (ends_a, ids_a), (ends_b, ids_b) = new
        if len(ends_a) and len(ends_b) and ends_a[-1] == ends_b[-1]:
            cut_a, cut_b = len(ends_a), len(ends_b)
        else:
            common = np.intersect1d(ends_a, ends_b, assume_unique=True)
            if not len(common):
                self.open = new
                return None
            cut_a, cut_b = int(np.searchsorted(ends_a, common[-1])) + 1, int(np.searchsorted(ends_b, common[-1])) + 1
        self.open = [(ends_a[cut_a:], ids_a[cut_a:]), (ends_b[cut_b:], ids_b[cut_b:])]
        start, self.upto = self.upto, int(ends_a[cut_a - 1])
        return self, ends_a[:cut_a] - start, ids_a[:cut_a], ends_b[:cut_b] - start, ids_b[:cut_b]


def _names(n_a: int, n_b: int) -> np.ndarray:
    """Each id with the comma after it, A's and then B's; then each with the mark that ends its side of a group."""
    ids = [*range(n_a), *range(n_b)]
    return np.array([f"{i},".encode() for i in ids] + [f"{i}{'|' if k < n_a else ';'}".encode() for k, i in enumerate(ids)])


def emit(parts: list[tuple], names: np.ndarray, sizes: tuple[int, int]) -> None:
    """Groups and links of parts that begin and end at common ends, entered in their documents.

    Between two neighbouring ends, whosever, one token of A and one of B are open: a link each. All parts are laid end to end, so
    each step is one pass over all their events.
    """
    if not parts:
        return
    documents = [p[0] for p in parts]
    n_a, n_b = (np.array([len(p[k]) for p in parts]) for k in (1, 3))
    lengths = np.array([p[1][-1] for p in parts])
    base = np.cumsum(lengths) - lengths
    ends_a, ends_b = (np.concatenate([p[k] for p in parts]) + np.repeat(base, n) for k, n in ((1, n_a), (3, n_b)))
    ids_a, ids_b = (np.concatenate([p[k] for p in parts]) for k in (2, 4))
    at = np.searchsorted(ends_b, ends_a)
    shared_a = ends_b[at] == ends_a  # the last end of B is common, so at is always within
    shared_b = np.zeros(len(ends_b), bool)
    shared_b[at[shared_a]] = True
    group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
    # all ends in order, common ones once
    by_a = np.zeros(len(ends_a) + len(ends_b) - int(shared_a.sum()), bool)
    place = np.arange(len(ends_a)) + at - group_a
    by_a[place] = True
    by_b = ~by_a
    by_b[place[shared_a]] = True
    links = ids_a[np.cumsum(by_a) - by_a] * sizes[1] + ids_b[np.cumsum(by_b) - by_b]
    # the tokens in the order of the digest's text: a group's A tokens, then its B tokens
    closed_a, closed_b = (np.concatenate(([0], np.flatnonzero(x) + 1)) for x in (shared_a, shared_b))
    codes = np.empty(len(ends_a) + len(ends_b), np.int64)
    half = len(names) // 2
    codes[np.arange(len(ends_a)) + closed_b[group_a]] = ids_a + half * shared_a
    codes[np.arange(len(ends_b)) + closed_a[group_b + 1]] = ids_b + sizes[0] + half * shared_b
    said = names[codes]
    tokens_upto, groups_upto = np.cumsum(n_a + n_b), np.cumsum(shared_a)[np.cumsum(n_a) - 1]
    groups = np.diff(groups_upto, prepend=0)
    n_links = n_a + n_b - groups
    owner = np.repeat(np.arange(len(parts)), n_links)
    span = sizes[0] * sizes[1]
    ordered = np.sort(owner * span + links)
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    numbers, distinct = np.diff(np.append(new, len(ordered))), ordered[new]
    upto = np.searchsorted(distinct, np.arange(1, len(parts) + 1) * span)
    for k, (doc, a, b, x, y) in enumerate(zip(documents, (tokens_upto - n_a - n_b).tolist(), tokens_upto.tolist(), [0, *upto[:-1].tolist()], upto.tolist())):
        text = said[a:b].tobytes().translate(None, b"\0")
        doc.digest.update(b";" * (doc.totals[0] > 0) + text[:-1])
        doc.totals = [t + int(v[k]) for t, v in zip(doc.totals, (n_a, n_b, groups, n_links))]
        doc.pairs.append((distinct[x:y] - k * span, numbers[x:y]))


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its counts."""
    all_ = np.concatenate([np.zeros(0, np.int64), *pairs])
    order = np.argsort(all_)
    all_, n = all_[order], np.concatenate([np.zeros(0, np.int64), *counts])[order]
    new = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1]))[: len(all_)])
    return all_[new], np.add.reduceat(n, new) if len(new) else n


def packed_links(pairs: np.ndarray, n: np.ndarray, tool: zstandard.ZstdCompressor) -> bytes:
    """Rising pairs as steps, then their numbers."""
    return tool.compress(np.diff(pairs, prepend=0).astype("<i8").tobytes() + n.astype("<u4").tobytes())


def unpacked_links(raw: bytes, tool: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    raw = tool.decompress(raw)
    size = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<i8", size)), np.frombuffer(raw, "<u4", size, 8 * size).astype(np.int64)


_DOC = "copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def swept(events: DataFrame, sizes: tuple[int, int], window: int = WINDOW, held: int = 1_500_000, block: int = 400_000) -> DataFrame:
    """Two kinds of rows. "doc": (id, t0, t1, copies, n_a, ... groups_sha256, links) of each document, links its id pairs
    and their numbers; equal rows of the input are one document with copies. "pairs": (pair, n) arrays, each task's links by id pair.

    Events meet by document, in order of their offsets. What a document keeps open is what has come since its last common
    end; closed parts of several documents, about `block` tokens together, are worked off at once.
    """
    kind = events.schema["id"].dataType.simpleString()
    key = ["id", "t0", "t1"]
    ordered = events.repartition(*key).sortWithinPartitions(*key, "win", "side")
    columns = [*key, *(x.split()[0] for x in _DOC.split(", ")), "pair", "n"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tool, pack = _names(*sizes), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=LEVEL)
        types = [_id_type(n) for n in sizes]
        document: Document | None = None
        waiting: list | None = None
        parts: list[tuple] = []
        ended: list[Document] = []
        pairs: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        size = 0

        def unpack(payload: bytes, win: int, side: int) -> tuple[np.ndarray, np.ndarray]:
            ends, ids = unpacked_events(payload, types[side], tool)
            return ends + win * window, ids

        def step() -> int:
            """What has come for the document's window is swept; returns the number of tokens."""
            part = document.take(waiting) if waiting else None
            if part:
                parts.append(part)
            return len(part[1]) + len(part[3]) if part else 0

        def rows(some: list[Document], doc_types: list[pa.DataType]) -> pa.RecordBatch:
            """The documents that have ended."""
            nonlocal size
            found = []
            for doc in some:
                if any(len(o[0]) for o in doc.open):
                    raise ValueError("the two tokenizers' tokens end at different offsets")
                pair, n = doc.pairs[0] if len(doc.pairs) == 1 else _summed(*map(list, zip(*doc.pairs))) if doc.pairs else _summed([], [])
                found.append((*doc.key, doc.copies, *doc.totals, doc.digest.hexdigest() if doc.totals[0] else "", packed_links(pair, n, pack)))
                pairs.append(pair)
                numbers.append(n * doc.copies)
                size += len(pair)
            arrays = [pa.array([r[j] for r in found], t) for j, t in enumerate(doc_types)]
            return pa.RecordBatch.from_arrays([pa.array(["doc"] * len(found), pa.string()), *arrays, *[pa.nulls(len(found), pa.list_(pa.int64()))] * 2], ["kind", *columns])

        def pair_rows(doc_types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
            found, n = _summed(pairs, numbers)
            for a in range(0, len(found), 50_000):
                one = [pa.array([x[a : a + 50_000]], pa.list_(pa.int64())) for x in (found, n)]
                yield pa.RecordBatch.from_arrays([pa.array(["pairs"]), *(pa.nulls(1, t) for t in doc_types), *one], ["kind", *columns])

        tokens, doc_types = 0, []
        for batch in sliced(batches):
            doc_types = [*(batch.schema.field(c).type for c in key), *[pa.int64()] * 5, pa.string(), pa.binary()]
            for *name, side, win, payload in zip(*(batch.column(c).to_pylist() for c in (*key, "side", "win", "payload"))):
                here = (win, side)
                if document is None or name != document.key:
                    if document is not None:
                        tokens += step()
                        ended.append(document)
                        if tokens > block or len(ended) >= 2000:
                            emit(parts, names, sizes)
                            yield rows(ended, doc_types)
                            parts, ended, tokens = [], [], 0
                    document, waiting = Document(name, here), None
                document.copies += here == document.first
                if side < 0 or here == document.seen:
                    continue  # no tokens, or an equal row's
                if waiting and document.seen[0] != win:
                    tokens += step()
                    waiting = None
                    if tokens > block:
                        emit(parts, names, sizes)
                        parts, tokens = [], 0
                waiting, document.seen = waiting or [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2, here
                waiting[side] = unpack(payload, win, side)
            if size > held:
                found, n = _summed(pairs, numbers)
                pairs, numbers, size = [found], [n], 0
                if len(found) > held:
                    yield from pair_rows(doc_types)
                    pairs, numbers = [], []
        if document is not None:
            step()
            emit(parts, names, sizes)
            yield rows([*ended, document], doc_types)
            yield from pair_rows(doc_types)

    return ordered.mapInArrow(sweep, f"kind string, id {kind}, t0 long, t1 long, {_DOC}, pair array<long>, n array<long>")


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): all links of the corpus by id pair; best: no pair with the same B id has more."""
    counts = found.where("kind = 'pairs'").select(F.inline(F.arrays_zip("pair", "n"))).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("b", F.col("pair") % n_b), "pair_counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    out = written(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")
    drop_written(counts)
    return out


def looked_up(found: DataFrame, counts: DataFrame, pairs_per_bucket: int = 1_000_000) -> DataFrame:
    """(id, t0, t1, n_best, count_sum) of every document: its links' pairs looked up in counts.

    The pairs are cut into buckets by hash, of about pairs_per_bucket, so a task holds one bucket of the table whatever the
    vocabularies. Table rows and documents' links meet by bucket and salt, the table's rows first, and stream by.
    """
    spark = found.sparkSession
    buckets = max(1, -(-counts.count() // pairs_per_bucket))
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    kind = found.schema["id"].dataType.simpleString()
    spread = np.uint64(0x9E3779B97F4A7C15)
    key = f"id {kind}, t0 long, t1 long"
    docs = found.where("kind = 'doc'").select("id", "t0", "t1", "links")
    if buckets == 1:
        parts = docs.withColumn("bucket", F.lit(0))
    else:

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=LEVEL)
            for batch in sliced(batches, 64):
                at, of, links = [], [], []
                for k, raw in enumerate(batch.column("links").to_pylist()):
                    pairs, n = unpacked_links(raw, tool)
                    bucket = ((pairs.astype(np.uint64) * spread) >> np.uint64(33)).astype(np.int64) % buckets
                    for b in np.unique(bucket).tolist() or [0]:
                        own = bucket == b
                        at.append(k)
                        of.append(b)
                        links.append(packed_links(pairs[own], n[own], pack))
                owners = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(owners) for c in ("id", "t0", "t1")), pa.array(links, pa.binary()), pa.array(of, pa.int32())], ["id", "t0", "t1", "links", "bucket"])

        parts = docs.mapInArrow(cut, f"{key}, links binary, bucket int")

    def pack_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
            bucket = ((pairs.astype(np.uint64) * spread) >> np.uint64(33)).astype(np.int64) % buckets
            rows = [(b, np.concatenate([x[bucket == b].astype("<i8") for x in (pairs, n, best)]).tobytes()) for b in np.unique(bucket).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "links"])

    table = counts.mapInArrow(pack_table, "bucket int, links binary")
    nobody = [F.lit(None).cast(t.dataType).alias(t.name) for t in docs.select("id", "t0", "t1").schema]
    table = table.select(*nobody, "links", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("turn"))
    parts = parts.select("id", "t0", "t1", "links", "bucket", F.pmod(F.xxhash64("t0", "id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("turn"))
    both = table.unionByName(parts).repartition(buckets * salts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "turn")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, held, place, rows = zstandard.ZstdDecompressor(), None, None, []
        for batch in sliced(batches):
            best_of, sums = [], []
            turns = batch.column("turn").to_pylist()
            for bucket, salt, turn, raw in zip(batch.column("bucket").to_pylist(), batch.column("salt").to_pylist(), turns, batch.column("links").to_pylist()):
                if (bucket, salt) != place:
                    place, rows, held = (bucket, salt), [], None
                if turn == 0:
                    rows.append(np.frombuffer(raw, "<i8").reshape(3, -1))
                    continue
                if held is None:
                    held = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0), np.int64)
                    held, rows = held[:, np.argsort(held[0])], []
                pairs, n = unpacked_links(raw, tool)
                at = np.searchsorted(held[0], pairs)
                best_of.append(int((n * held[2][at]).sum()))
                sums.append(int((n * held[1][at]).sum()))
            mine = batch.filter(pa.array([t == 1 for t in turns], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in ("id", "t0", "t1")), pa.array(best_of, pa.int64()), pa.array(sums, pa.int64())], ["id", "t0", "t1", "n_best", "count_sum"])

    return both.mapInArrow(look, f"{key}, n_best long, count_sum long")


def align(docs: DataFrame, vocabularies: Callable[[], tuple[Vocabulary, Vocabulary]], id_col: str = "doc_id", text_col: str = "text", pairs_per_bucket: int = 1_000_000, window: int = WINDOW) -> DataFrame:
    """Written table (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    vocabularies() makes A and B, in each task. Byte offsets at which a token of A and one of B
    both end cut a text's tokens into groups; tokens whose byte ranges overlap are linked. count_sum adds up, over the
    links, how many links of the whole corpus hold the same id pair; n_best counts the links whose pair no other pair of its
    B id exceeds. A text that is null or empty, or that a vocabulary doesn't give back byte for byte after a blank, has no tokens:
    zeros and an empty digest. Equal rows are encoded each, swept as one and counted each.
    """
    texts = inputs(docs, id_col, text_col).withColumns(text_keys(F.coalesce("text", F.lit(""))))
    sizes = tuple(len(v.bytes) for v in vocabularies())
    found = written(swept(end_events(texts, vocabularies, window), sizes, window), "aligned", ["kind"])
    release(docs.sparkSession)
    counts = pair_counts(found, sizes[1])
    key = ["id", "t0", "t1"]
    sums = looked_up(found, counts, pairs_per_bucket).groupBy(*key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    same = [found[c].eqNullSafe(sums[c]) for c in key]
    rows = found.where("kind = 'doc'").join(sums, same, "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    totals = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = written(rows.select(found["id"], *totals, "groups_sha256"), "alignment")
    drop_written(found)
    drop_written(counts)
    return out
