"""Quality rules: counts of a text's defects, and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import inputs
from .kernels import RangeHash, chunks, joined, mix, sliced, words

#: Larger tables of trusted ids are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: The characters that count as symbols.
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def base_counts(texts: list[bytes], window: int = 8) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    word_chars: code points in words. n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words in
    runs of `window` words that the text holds twice or more, the first included.
    """
    buf, at = joined(texts)
    start, end = words(buf)
    first = np.searchsorted(start, at)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[buf])))
    total = lambda x, of=owner: np.bincount(of, weights=x, minlength=len(texts)).astype(np.int64)
    repeated = np.zeros(len(start), bool)
    n = len(start) - window + 1
    if n > 0:
        hashes = RangeHash(buf).of(start, end)
        runs = mix(hashes[:n] + owner[:n].astype(np.uint64))
        for k in range(1, window):
            runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k])
        inside = np.flatnonzero(owner[:n] == owner[window - 1 :])
        _, which, count = np.unique(runs[inside], return_inverse=True, return_counts=True)
        for k in range(window):
            repeated[inside[count[which] > 1] + k] = True
    lines = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        full = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        lines[k] = len(full) - len(set(full))
    return {"n_words": np.diff(first), "word_chars": total(chars[end] - chars[start]), "n_symbols": symbols[at[1:] - 1] - symbols[at[:-1]], "n_dup_lines": lines, "n_repeat_words": total(repeated)}


def _grams(buf: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the three bytes at each place."""
    b = buf.astype(np.uint32)
    key = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return (key >> np.uint32(32 - buckets)).astype(np.int64)


def gram_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, bits: int) -> np.ndarray:
    """Counts [2, 2**bits] of hashed byte trigrams within texts: of all rows, and of rows whose id is in trusted (of).

    trusted has each id once; see _side for its join. Each task sums its rows
    first, so what the sums shuffle is at most 2**bits rows a task; 2**bits sums come to the driver.
    """
    rows = inputs(docs, id_col, text_col).join(_side(trusted), F.col("id") == F.col("of"), "left").select("text", F.col("of").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << bits), np.int64)
        for batch in sliced(batches):
            good = np.asarray(batch.column("good").to_pylist(), bool)
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                buf, at = joined(texts[a:b])
                if len(buf) < 3:
                    continue
                grams = _grams(buf, bits)
                owner = np.repeat(np.arange(b - a), np.diff(at))
                inside = np.arange(len(grams)) + 3 < at[owner[:-2] + 1]
                sums[0] += np.bincount(grams[inside], minlength=1 << bits)
                sums[1] += np.bincount(grams[inside & good[a:b][owner[:-2]]], minlength=1 << bits)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])], ["bucket", "raw", "good"])

    out = np.zeros((2, 1 << bits), np.int64)
    for r in rows.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        out[:, r["bucket"]] = r["raw"], r["good"]
    return out


def trusted_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(of): all ids labelled 1, each once."""
    return labels.select(F.col(id_col).alias("of"), F.col(label_col).alias("label")).dropna().groupBy("of").agg(F.min("label").alias("label")).where("label = 1").select("of")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 15, threshold: float | None = -0.5, smoothing: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept) for every row.

    ratio: mean over a text's byte trigrams of log(trusted share / raw share) of their hash buckets. The raw multinomial
    counts every row, the trusted one every row labelled 1. base_failed: fewer than min_words words, or over
    max_repeat_percent % repeated words. kept: not base_failed, and ratio at least threshold; the same text always gets the same verdict. Null texts are empty and fail; a text under three bytes has
    ratio 0; without labels every ratio is 0. threshold None takes it from the trusted rows (see below_trusted).
    """
    raw, good = gram_counts(docs, trusted_ids(labels, id_col, label_col), id_col, text_col, bits)
    shares = lambda x: (x + smoothing) / (x.sum() + smoothing * len(x))
    weight = np.log(shares(good) / shares(raw)) if good.sum() else np.zeros(1 << bits)
    out = _judged(inputs(docs, id_col, text_col), weight, bits)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    if threshold is None:
        trusted = inputs(docs, id_col, text_col).join(_side(trusted_ids(labels, id_col, label_col)), F.col("id") == F.col("of")).select("id", "text")
        threshold = below_trusted(_judged(trusted, weight, bits).where(~failed))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("ratio") >= threshold))


def below_trusted(trusted: DataFrame, share: float = 0.01, times: float = 10.0) -> float:
    """The threshold that lies `times` as far below the trusted rows' median ratio as their lowest `share` begins; without rows, minus infinity.

    From counts of ratios in steps of 0.001, all rows counted, so it's the same however the rows are dealt; a row a step comes to the driver.
    """
    steps = sorted((r["step"], r["count"]) for r in trusted.groupBy(F.floor(F.col("ratio") * 1000).alias("step")).count().collect())
    if not steps:
        return float("-inf")
    value, upto = np.array([v for v, _ in steps]) / 1000, np.cumsum([n for _, n in steps])
    low, middle = (float(value[np.searchsorted(upto, q * upto[-1])]) for q in (share, 0.5))
    return middle - times * max(middle - low, 0.001)


def _side(trusted: DataFrame) -> DataFrame:
    """The trusted ids, each once, as a join's side: broadcast up to BROADCAST_BYTES (at 64 a row), beyond that joined by shuffle."""
    return F.broadcast(trusted) if trusted.count() * 64 <= BROADCAST_BYTES else trusted.hint("merge")


def _judged(texts: DataFrame, weight: np.ndarray, bits: int) -> DataFrame:
    """(id, base counts, ratio) of every row of texts (id, text)."""
    kind = texts.schema["id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            counts: dict[str, list] = {x: [] for x in names}
            ratios = []
            for a, b in chunks(texts):
                for k, v in base_counts(texts[a:b]).items():
                    counts[k].append(v)
                buf, at = joined(texts[a:b])
                grams = np.concatenate((weight[_grams(buf, bits)], np.zeros(3))) if len(buf) > 2 else np.zeros(len(buf) + 3)
                sums = np.concatenate(([0.0], np.cumsum(grams)))
                last = np.maximum(at[:-1], at[1:] - 3)  # after the last trigram within the text
                ratios.append((sums[last] - sums[at[:-1]]) / np.maximum(1, last - at[:-1]))
            arrays = [pa.array(np.concatenate(counts[x]) if ratios else np.zeros(0, np.int64)) for x in names]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays, pa.array(np.concatenate(ratios) if ratios else np.zeros(0))], ["id", *names, "ratio"])

    return texts.mapInArrow(judge, f"id {kind}, " + ", ".join(f"{x} long" for x in names) + ", ratio double")
