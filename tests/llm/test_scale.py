"""Very long texts, hot keys and hashes that collide."""

import math
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordshield.llm import chat_format, decontamination, license_scan, near_dedup, packing, quality_classifier, quality_rules, queries, suffix_dedup, token_counts
from wordshield.llm.components import connected_components, refined

from .test_operators import ITEMS, brute_base, brute_components, brute_hits, check_packing

LONG = " ".join(f"w{k * 7919 % 1_000_003}" for k in range(400_000))  # 3 MB without repeats
PASSAGE = " ".join(f"passage{k}" for k in range(40))


def test_texts_of_several_megabytes(spark):
    item = " ".join(f"b{k}" for k in range(15))
    rows = [(1, f"{LONG} {PASSAGE} {item}"), (2, f"{PASSAGE} {LONG[:-7]} end"), (3, "é" * 2_000_000), (4, f"short {PASSAGE}"), (5, "日本 " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = decontamination.decontaminate(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == brute_hits(rows, ITEMS)
    got = near_dedup.near_duplicates(df, width=2).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_components(rows, 2)
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    got = quality_rules.quality_rules(df, labels).collect()
    assert Counter((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == Counter((k, *brute_base(t)) for k, t in rows)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r["id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counts == {k: (len(t.encode()), len(model.encode(t, add_special_tokens=False).ids)) for k, t in rows}
    check_packing(df, queries.packed_pieces(df))
    cut = {r["id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert cut[4]["kept"].decode() == "short" and sum(s["end"] - s["start"] for s in cut[4]["spans"]) == len(PASSAGE) + 1
    assert len(cut[3]["kept"]) == 0 and len(cut[1]["kept"]) < 200
    quality = quality_classifier.train(df, labels)
    assert quality_classifier.score(df, quality).count() == 5
    assert license_scan.scan_licenses(df, license_scan.train(df)).count() == 5
    turns = spark.createDataFrame([(1, 0, "user", rows[0][1]), (1, 1, "assistant", rows[2][1])], "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.format_chats(turns)).collect()
    assert sorted(t["text"] for r in back for t in r["turns"]) == sorted((rows[0][1], rows[2][1]))


def test_runs_of_blanks_take_no_longer_than_other_texts():
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("<|endoftext|>", 50_256), public_tokenizers.path("byte_bpe_50k.json"))
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    took = {}
    for gap in (5, 499, 501, 9_999):
        text = ("a" + " " * gap) * (500_000 // gap)
        encode(text[:2000])
        began = time.process_time()
        ids = encode(text)
        took[gap] = time.process_time() - began
        assert ids.tolist() == model.encode(text, add_special_tokens=False).ids
    assert max(took.values()) < 5 + took[5], took


def test_token_batches_count_bytes():
    texts = ["日本語 " * 1000, "abc " * 1000, "", "é" * 40] * 5
    made = list(token_counts.batches_of(texts, 500, 30_000))
    sizes = [sum(len(p.encode()) for p in pieces) for _, pieces in made]
    assert all(30_000 <= n < 32_000 for n in sizes[:-1]) and len(sizes) > 2
    back = ["".join(p for owners, pieces in made for o, p in zip(owners, pieces) if o == k) for k in range(len(texts))]
    assert back == texts


def test_scores_by_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = queries.quality_model(spark, docs, "/root/testdata/sf0.01")
    w = {k: np.asarray(v, float).tolist() for k, v in model.weights.items()}
    rows = docs.orderBy("doc_id").limit(12).select("doc_id", "text").collect()
    got = {r["id"]: r["score"] for r in quality_classifier.score(docs.where(F.col("doc_id").isin([r[0] for r in rows])), model).collect()}
    for doc_id, text in rows:
        x, _ = quality_classifier.passages([text.encode()])
        encoded, raised = [], []
        for features in ((x - model.centre) / model.scale).astype(float).tolist():
            h = [math.tanh(sum(f * w["encode"][i][j] for i, f in enumerate(features)) + b) for j, b in enumerate(w["encode_b"])]
            t = [math.tanh(sum(h[i] * w["tanh"][i][j] for i in range(len(h)))) for j in range(len(w["attend"]))]
            g = [1 / (1 + math.exp(-sum(h[i] * w["gate"][i][j] for i in range(len(h))))) for j in range(len(w["attend"]))]
            encoded.append(h)
            raised.append(math.exp(sum(a * u * v for a, u, v in zip(w["attend"], t, g))))
        z = [sum(r * h[j] for r, h in zip(raised, encoded)) / sum(raised) for j in range(len(w["out"]))]
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, w["out"])) - w["out_b"]))
        assert abs(want - got[doc_id]) < 1e-4


def test_a_star_of_many_nodes(spark):
    links = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    far = spark.range(200_000, 200_010).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = connected_components(links.union(far))
    assert {(r["label"], r["n"]) for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()} == {(0, 100_001), (200_000, 11)}
    more = refined(labels, links.union(far).union(spark.createDataFrame([(77, 200_005)], "a long, b long")))
    assert [(r["label"], r["n"]) for r in more.groupBy("label").agg(F.count("*").alias("n")).collect()] == [(0, 100_012)]


def test_no_link_is_lost_where_parts_of_band_keys_are_equal(spark, monkeypatch):
    """All bands' keys agree modulo 2**31 - 1, so a shortened key would take any two for the same."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        w = [f"t{j}" for j in range(60)]
        for p in rng.choice(60, k % 14, replace=False):
            w[p] = f"n{k}x{p}"
        rows.append((k, " ".join(w)))
    signatures, linked = near_dedup.signatures, near_dedup._linked
    alike = lambda v: v - F.pmod(v, F.lit(2_147_483_647)) + 5
    monkeypatch.setattr(near_dedup, "signatures", lambda *a: signatures(*a).withColumn("bands", F.transform("bands", alike)))
    monkeypatch.setattr(near_dedup, "_linked", lambda *a: linked(*a, all_pairs_up_to=4, centres=1, per_task=7))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, width=2).collect())
    assert got == brute_components(rows, 2)


def relatives(n, own, words=400, seed=4):
    """Texts of a base of `words` words of which `own` shares are each text's own."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        w = [f"t{j}" for j in range(words)]
        for p in rng.choice(words, int(words * own[k % len(own)]), replace=False):
            w[p] = f"n{k}x{p}"
        rows.append((k, " ".join(w)))
    return rows


def test_relatives_that_are_not_similar_enough_are_not_all_verified(spark, monkeypatch):
    """One bucket of 160 near copies and 40 texts that are about 0.74 like each of them: too many of their bits are common to rule that out by bitmaps."""
    rows = relatives(200, [0.067, 0.005, 0.005, 0.01, 0.01])
    signatures, verified, tried = near_dedup.signatures, near_dedup.verified, []
    monkeypatch.setattr(near_dedup, "signatures", lambda *a: signatures(*a).withColumn("bands", F.array(F.lit(1).cast("long"))))
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *a: tried.append(pairs.count()) or verified(pairs, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, width=2).collect())
    assert got == brute_components(rows, 2)
    assert sum(tried) < 10 * len(rows)


def test_every_similar_pair_of_different_labels_meets_by_its_rarest_shingles(spark):
    """Texts of many lengths, few and many words of their own, and few words in all; labels at random."""
    rng = np.random.default_rng(6)
    texts = [t for _, t in relatives(90, [0, 0.02, 0.05, 0.07, 0.1], 60)]
    texts += [" ".join(t.split()[: 45 + k % 15]) for k, t in enumerate(texts[:60])]
    texts += [" ".join(rng.choice(["a", "b", "c"], 1 + k % 9)) for k in range(60)]
    label = rng.integers(0, 40, len(texts)).tolist()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    nodes = near_dedup.signatures(df, 2, 4, 5).select(F.col("id").alias("node"), F.col("n_shingles").alias("n"), "bitmap")
    members = spark.createDataFrame(list(enumerate(label)), "node long, label long")
    found = near_dedup._apart(members, nodes, df.select(F.col("id").alias("node"), "text"), 2, 80, 7).collect()
    got = {(r["a"], r["b"]) for r in found}
    assert len(found) == len(got) and all(a < b and label[a] != label[b] for a, b in got)
    sets = [set(zip(w, w[1:])) if len(w := t.split()) > 1 else {tuple(w)} for t in texts]
    similar = {(a, b) for b in range(len(texts)) for a in range(b) if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(similar) > 300 and similar <= got


def test_words_of_long_text_are_all_different():
    assert len(set(re.findall(r"\S+", LONG))) == 400_000
