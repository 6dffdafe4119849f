"""Best-fit packing of tokenised documents into sequences of fixed length, with certified bin counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .kernels import sliced


#: A run of white space that the pattern of the ranks might not take, or only slowly.
_LONG_GAP = re.compile(r"\s{500}")


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a .tiktoken file and their ids."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def load_ranks(ranks_path: str, pattern: str, end_of_text: tuple[str, int] | None):
    """The byte-level BPE of a .tiktoken file; end_of_text is matched inside texts, as the twin .json does by default."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens=dict([end_of_text] if end_of_text else []))


def encoder(ranks_path: str, pattern: str, end_of_text: tuple[str, int] | None, tokenizer_path: str):
    """Token ids of a text, by the ranks or, where their pattern can't take the text (its time grows with the square of a run of blanks, and very long ones exhaust its backtracking), by the tokenizer file.

    Without end_of_text no special token is matched: its string is plain text.
    """
    model, names, slow = load_ranks(ranks_path, pattern, end_of_text), {end_of_text[0]} if end_of_text else set(), []

    def encode(text: str) -> np.ndarray:
        if not _LONG_GAP.search(text):
            try:
                return model.encode_to_numpy(text, allowed_special=names, disallowed_special=())
            except ValueError:
                pass
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(tokenizer_path))
            slow[0].no_truncation()
            slow[0].encode_special_tokens = not names
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, and what is over as a shorter first piece."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def encode_pieces(docs: DataFrame, ranks_path: str, pattern: str, end_of_text: tuple[str, int], tokenizer_path: str, final_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (piece_key, id, piece, start, length, ids): each row's token ids (little-endian unsigned 32-bit), cut.

    Equal rows are packed each for itself: piece_key, not the id, names a piece. A null text is empty: one piece, final_id. An empty table gives an empty one.
    """
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(ranks_path, pattern, end_of_text, tokenizer_path)
        for batch in sliced(batches):
            rows: dict[str, list] = {x: [] for x in ("at", "piece", "start", "length", "ids")}
            size = 0

            def made(rows: dict[str, list], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows["at"], pa.int64())), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()), pa.array(rows["ids"], pa.binary())], ["id", "piece", "start", "length", "ids"])

            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(model(text), final_id).astype("<u4")
                start = 0
                for piece, n in enumerate(cut_lengths(len(ids), capacity)):
                    for name, x in (("at", k), ("piece", piece), ("start", start), ("length", n), ("ids", ids[start : start + n].tobytes())):
                        rows[name].append(x)
                    start += n
                size += 4 * len(ids)
                if size > 8_000_000:
                    yield made(rows)
                    rows, size = {x: [] for x in rows}, 0
            yield made(rows)

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    pieces = texts.mapInArrow(encode, f"id {kind}, piece int, start long, length long, ids binary")
    return written(pieces.withColumn("piece_key", F.monotonically_increasing_id()), "pieces")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill: longest first, each into the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    some = 0  # bit r: free[r] isn't empty
    room: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = some >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some &= ~(1 << left)
        else:
            b, left = len(room), capacity
            room.append(0)
        bins[k], offsets[k] = b, capacity - left
        left -= n
        room[b] = left
        if left:
            free[left].append(b)
            some |= 1 << left
    return bins, offsets, capacity - np.array(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the dual feasible functions below, each a sum of rounded sizes.

    For a threshold t up to half the capacity, items above capacity - t count as whole bins and those below t as
    nothing; for k, the function that rounds (k + 1) * size / capacity to steps of 1 / k.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(0, capacity // 2 + 1)
    whole = number[-1] - number[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[t - 1], 0)
    best = int(np.max(whole + -(-middle // capacity)))
    for k in range(1, 21):
        steps, exact = np.divmod((k + 1) * sizes, capacity)
        value = np.where(exact == 0, (k + 1) * sizes * k, steps * capacity * (k + 1))
        # in units of 1 / (k * (k + 1) * capacity)
        best = max(best, -(-int(np.sum(counts * value)) // (k * (k + 1) * capacity)))
    return best


def _pack_partitions(items: DataFrame, seed: int, n: int, capacity: int) -> DataFrame:
    """Best-fit decreasing in each of n partitions: (piece_key, length, part, bin, offset, fill, bins, bound)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece_key", ignore_index=True)
        bins, offsets, fill = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], bins=len(fill), bound=lower_bound(pdf["length"].to_numpy(), capacity))

    dealt = items.select("piece_key", "length", F.pmod(F.xxhash64(F.lit(seed), "piece_key"), F.lit(n)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, "piece_key long, length long, part int, bin long, offset long, fill long, bins long, bound long")


def pack(pieces: DataFrame, capacity: int, items_per_partition: int = 100_000, rounds: int = 6) -> DataFrame:
    """(piece_key, sequence_id, offset) for every row of pieces (piece_key, length <= capacity).

    Full pieces are sequences of their own. The others are dealt over partitions of about items_per_partition and packed
    best-fit decreasing. Dual feasible functions bound each partition's bins from below. A partition that meets its
    bound keeps all bins but its emptiest; one with a gap keeps its full bins. The documents of all other bins meet
    in fewer partitions and are packed again, until one partition has taken all that is left, or rounds are over (then
    the last round's bins stay). Nothing is dropped: a round only changes which bins are final. Pieces of equal length are taken by
    piece_key; an empty table gives an empty one.
    """
    full = pieces.where(F.col("length") == capacity).select("piece_key", (F.col("piece_key") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items, final = pieces.where(F.col("length") < capacity).select("piece_key", "length"), [full]
    count, old = items.count(), None
    for r in range(rounds):
        n = max(1, -(-count // items_per_partition))
        packed = written(_pack_partitions(items, r, n, capacity), "packed")
        if old is not None:
            drop_written(old)
        last = n == 1 or r == rounds - 1
        gap = F.col("bins") > F.col("bound")
        stays = F.lit(True) if last else F.when(gap, F.col("fill") == capacity).otherwise(F.col("fill") > F.col("emptiest"))
        judged = packed
        if not last:
            least = packed.groupBy("part").agg(F.min("fill").alias("emptiest"))
            judged = packed.join(F.broadcast(least) if n <= 100_000 else least, "part")
        judged = judged.withColumn("stays", stays)
        number = F.shiftleft(F.lit(r + 1).cast("long"), 58) + F.shiftleft(F.col("part").cast("long"), 26) + F.col("bin")
        kept = written(judged.where("stays").select("piece_key", (number * 2).alias("sequence_id"), "offset"), "placed")
        final.append(kept)
        if last:
            drop_written(packed)
            break
        old = written(judged.where("not stays").select("piece_key", "length"), "open")
        drop_written(packed)
        items, count = old, old.count()
        if not count:
            break
    out = final[0]
    for df in final[1:]:
        out = out.unionByName(df)
    return out
