"""Document quality by attention-based multiple-instance learning over encoded passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import inputs
from .kernels import LOWER, RangeHash, chunks, joined, mix, sliced, words

PASSAGE_WORDS = 64
#: Weight decays to choose from.
DECAYS = (1e-4, 1e-3, 1e-2)
#: Classes of bytes: lower case, upper case, digits, beyond ASCII, blanks, line ends, other control bytes; each other ASCII character is its own.
_CLASS = np.full(256, 6)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[128:], _CLASS[[0x20, 0x09]], _CLASS[0x0A] = 3, 4, 5
_MARKS = [c for c in range(0x21, 0x7F) if _CLASS[c] == 6]
_CLASS[_MARKS] = np.arange(7, 7 + len(_MARKS))
_CLASSES = 7 + len(_MARKS)
#: Buckets into which words and word pairs are hashed, each with a sign.
NGRAM_BITS = 6
FEATURES = _CLASSES + 6 + (1 << NGRAM_BITS)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of PASSAGE_WORDS words (the last may be shorter), and each text's first passage (and the end).

    A text without words is one empty passage. Features: square roots of the shares of byte classes, mean word length,
    shares of upper-case words, of words and of 3-word runs that the text had before, of short lines, and size; and signed
    counts of the passage's lower-cased words and word pairs by hash, over the root of their number.
    """
    buf, at = joined(texts)
    start, end = words(buf)
    first = np.searchsorted(start, at)
    counts = np.maximum(1, -(-np.diff(first) // PASSAGE_WORDS))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    n = int(bounds[-1])
    owner = np.repeat(np.arange(len(texts)), np.diff(first))  # each word's text
    of_word = bounds[owner] + (np.arange(len(start)) - first[owner]) // PASSAGE_WORDS
    # bytes belong to the passage of the last word that began before them
    edges = at[:-1][np.repeat(np.arange(len(texts)), counts)].copy()
    opens = np.flatnonzero(np.diff(of_word, prepend=-1))
    later = of_word[opens] > bounds[owner[opens]]
    edges[of_word[opens][later]] = start[opens[later]]
    of_byte = np.repeat(np.arange(n), np.diff(np.append(edges, len(buf))))
    shares = np.bincount(of_byte * _CLASSES + _CLASS[buf], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float32)
    size = shares.sum(1, keepdims=True)
    upper = np.concatenate(([0], np.cumsum((buf >= 65) & (buf <= 90))))
    lower = np.concatenate(([0], np.cumsum((buf >= 97) & (buf <= 122))))
    shouted = (upper[end] - upper[start] > 1) & (lower[end] == lower[start])
    word = RangeHash(LOWER[buf]).of(start, end)
    hashes = mix(word + owner.astype(np.uint64))  # told apart by text

    def seen(values: np.ndarray) -> np.ndarray:
        again = np.ones(len(values), bool)
        again[np.unique(values, return_index=True)[1]] = False
        return again

    runs = mix(mix(hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(3) + hashes[2:]) if len(hashes) > 2 else hashes[:0]
    per = np.maximum(1, np.bincount(of_word, minlength=n))
    mean = lambda x, of: np.bincount(of, weights=x, minlength=n) / per
    more = [mean(end - start, of_word) / 10, mean(shouted, of_word), mean(seen(hashes), of_word), mean(seen(runs), of_word[: len(runs)]), shares[:, 5] / np.sqrt(per), np.log1p(per) / 5]
    pair = np.flatnonzero(of_word[1:] == of_word[:-1])
    gram = np.concatenate((word, mix(word[pair] * np.uint64(3) + word[pair + 1])))
    of_gram = np.concatenate((of_word, of_word[pair]))
    bucket = (gram >> np.uint64(64 - NGRAM_BITS)).astype(np.int64)
    sign = 1.0 - 2.0 * (gram & np.uint64(1))
    grams = np.bincount((of_gram << NGRAM_BITS) + bucket, weights=sign, minlength=n << NGRAM_BITS).reshape(n, -1)
    grams = grams / np.sqrt(np.maximum(1, np.bincount(of_gram, minlength=n)))[:, None]
    return np.concatenate([np.sqrt(shares / np.maximum(size, 1)), np.stack(more, 1), grams], 1).astype(np.float32), bounds


@dataclass
class Model:
    """Standardised features -> tanh encoding -> gated attention weights -> weighted encoding -> logistic score."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.weights, bounds[:-1]
        h = np.tanh(x @ w["encode"] + w["encode_b"])
        t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        a = (t * g) @ w["attend"]
        counts = np.diff(bounds)
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, at), counts))
        p = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(p[:, None] * h, at)
        return {"h": h, "t": t, "g": g, "p": p, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))}

    def scores(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.forward((x - self.centre) / self.scale, bounds)["score"].astype(np.float64)


def slopes(model: Model, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The mean log loss of document labels y, by each weight, for standardised features x."""
    w, counts, at = model.weights, np.diff(bounds), bounds[:-1]
    f = model.forward(x, bounds)
    ds = (f["score"] - y) / len(y)
    dz = np.repeat(ds[:, None] * w["out"], counts, axis=0)
    dp = (dz * f["h"]).sum(1)
    da = f["p"] * (dp - np.repeat(np.add.reduceat(f["p"] * dp, at), counts))
    dq = da[:, None] * w["attend"]
    dt, dg = dq * f["g"] * (1 - f["t"] ** 2), dq * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["p"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
    return {"encode": x.T @ dh, "encode_b": dh.sum(0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "attend": (f["t"] * f["g"]).T @ da, "out": f["z"].T @ ds, "out_b": ds.sum()}


def fit(x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, encoding: int = 24, gates: int = 12, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the log loss of document labels; only documents carry labels, so passages' weights are learned."""
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(0), x.std(0) + x.dtype.type(1e-2)
    d, y = x.shape[1], labels.astype(x.dtype)
    make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(x.dtype)
    none = lambda *s: np.zeros(s, x.dtype)
    w = {"encode": make(d, encoding), "encode_b": none(encoding), "tanh": make(encoding, gates), "gate": make(encoding, gates), "attend": make(gates), "out": make(encoding), "out_b": none()}
    model, x = Model(centre, scale, w), (x - centre) / scale
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, steps + 1):
        slope = slopes(model, x, bounds, y)
        for k, v in slope.items():
            m, s = moments[k]
            v = v + decay * w[k]
            m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v
            moments[k] = m, s
            w[k] = w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        blobs = []
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        for a, b in chunks(texts):
            x, bounds = passages(texts[a:b])
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                picked = np.unique(np.linspace(low, high - 1, min(most, high - low)).astype(int))
                blobs.append(x[picked].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(blobs, pa.binary())], ["id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_documents: int = 6000, most_passages: int = 32) -> Model | None:
    """Fit on a bounded sample: about most_documents labelled documents, by hash of the id, of each at most most_passages.

    Several labels of one document count as their mean; null ids and labels teach nothing. None without both labels.
    The sample of ids is broadcast (its size is bounded), so documents aren't shuffled; encoding runs in tasks.
    Of DECAYS the one is taken that gives the least log loss on every fifth document of the sample when fitted on the others in 120 steps.
    """
    known = labels.select(F.col(id_col).alias("of"), F.col(label_col).alias("label")).dropna().groupBy("of").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    count = known.count()
    share = min(1.0, most_documents / max(1, count))
    picked = known.where(F.pmod(F.xxhash64("of", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * most_documents)
    rows = inputs(docs, id_col, text_col).join(F.broadcast(picked), F.col("id") == F.col("of")).select("id", "label", "text")
    kind = rows.schema["id"].dataType.simpleString()
    found = sorted(rows.mapInArrow(lambda b: _feature_rows(b, most_passages), f"id {kind}, label int, x binary").collect())
    if len({r["label"] for r in found}) < 2:
        return None
    blocks = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in found]
    y = np.array([r["label"] for r in found])

    def bags(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [blocks[k] for k in np.flatnonzero(of)]
        return np.concatenate(own), np.concatenate(([0], np.cumsum([len(b) for b in own]))), y[of]

    aside = np.arange(len(y)) % 5 == 4
    if not all(len(set(y[of])) == 2 for of in (aside, ~aside)):
        return fit(*bags(aside | ~aside))

    def loss(decay: float) -> float:
        x, bounds, want = bags(aside)
        got = np.clip(fit(*bags(~aside), steps=120, decay=decay).scores(x, bounds), 1e-6, 1 - 1e-6)
        return float(-np.mean(np.log(np.where(want == 1, got, 1 - got))))

    return fit(*bags(aside | ~aside), decay=min(DECAYS, key=loss))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, from its whole text alone; a null text is empty. Without a model (no labels of both kinds) nothing speaks against any text: every score is 1, and a filter keeps all.

    Every passage is encoded and weighted; no shuffle, memory bounded by an Arrow batch and the longest text.
    """
    texts = inputs(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data = [t.encode() for t in batch.column("text").to_pylist()]
            found = [model.scores(*passages(data[a:b])) if model else np.ones(b - a) for a, b in chunks(data)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(found) if found else np.zeros(0))], ["id", "score"])

    return texts.mapInArrow(rate, f"id {kind}, score double")


def keep_good(docs: DataFrame, model: Model | None, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text scores at least threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
            found = [model.scores(*passages(data[a:b])) if model else np.ones(b - a) for a, b in chunks(data)]
            yield batch.filter(pa.array(np.concatenate(found) >= threshold)) if found else batch

    return docs.mapInArrow(keep, docs.schema)
