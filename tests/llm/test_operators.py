"""Each operator against a brute-force version, on the small tables and on rows with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordshield.llm import chat_format, decontamination, license_scan, near_dedup, packing, quality_classifier, quality_rules, queries, sharding, suffix_dedup, token_counts
from wordshield.llm.components import connected_components, refined

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k}" for k in range(400))
#: Nulls in any column, empty texts, ties, repeated rows, a text without blanks, columns whose names the operators use inside.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "One"), (4, "One"), (5, "one"), (6, "x" * 3000), (7, LONG), (8, LONG), (8, LONG), (9, LONG + " end"), (None, "Alone a b"), (None, LONG), (10, "é ß <|endoftext|> 日本語 \u0085  z"), (11, LONG + "\n" + LONG)]
#: item 1 lies in 2 and 3; item 4 is short.
ITEMS = [(1, " ".join(f"b{k}" for k in range(15))), (2, " ".join(f"b{k}" for k in range(30))), (3, "Tiny ITEM"), (4, None), (5, "..."), (None, " ".join(f"n{k}" for k in range(13))), (1, " ".join(f"b{k}" for k in range(15)))]


@pytest.fixture(scope="module")
def odd(spark):
    more = [(20, "b1 b2 " + " ".join(f"B{k}" for k in range(15)) + ", tail"), (21, " ".join(f"b{k}" for k in range(12))), (22, "a tiny, item! here " + "pad " * 60), (23, " ".join(f"n{k}" for k in range(13)) + " x"), (24, "tiny item tiny item")]
    df = spark.createDataFrame(ODD + more, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("id", "t0", "t1", "node", "row", "spans", "bands", "size", "part", "number", "label")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs_of(df, text="text"):
    return [(r[0], r[1]) for r in df.select("doc_id", text).collect()]


def empty(df):
    return df.where("false")


def test_token_counts(odd, docs):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (odd, docs, empty(odd)):
        rows = pairs_of(df)
        want = Counter((k, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for k, t in rows)
        for piece in (50_000, 40):
            got = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), piece_chars=piece, batch_chars=500)
            assert Counter(tuple(r) for r in got.collect()) == want


def test_token_counts_sentencepiece(odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((k, len(model.encode(t or ""))) for k, t in pairs_of(odd))
    assert Counter((r["id"], r["n_tokens"]) for r in token_counts.token_counts(odd, path).collect()) == want


def test_the_two_vocabularies_encode_alike():
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    twin = packing.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("<|endoftext|>", 50_256))
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 64):
        text = " a".join(points[low : low + 64]) + "".join(points[low : low + 64])
        assert model.encode(text, add_special_tokens=False).ids == twin.encode(text, allowed_special={"<|endoftext|>"}), hex(ord(points[low]))


def check_packing(df, out, capacity=1024):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for k, t in pairs_of(df):
        ids, start = [*model.encode(t or "", add_special_tokens=False).ids, 2], 0
        for piece, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            want.append((k, piece, start, n, zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n]))))
            start += n
    rows = out.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == Counter(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), packing.lower_bound(np.array([r["length"] for r in rows] or [0]), capacity)


def test_packing(odd, docs):
    for df in (odd, docs, empty(odd)):
        bins, bound = check_packing(df, queries.packed_pieces(df))
        assert bound <= bins <= bound * 1.02 + 1


def test_packing_over_partitions(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 64, 5000)
    items = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "piece_key long, length long")
    got = packing.pack(items, 64, items_per_partition=700).join(items, "piece_key").collect()
    assert len(got) == 5000
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 64 and [o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))])[:-1].tolist() for b in bins.values())
    assert len(bins) <= packing.lower_bound(lengths, 64) * 1.02


def test_lower_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(50):
        groups = [rng.multinomial(32, [1 / 4] * 4) for _ in range(20)]  # 20 full bins
        sizes = np.array([x for g in groups for x in g if x])
        assert packing.lower_bound(sizes, 32) == 20
    assert packing.lower_bound(np.array([6, 6, 6, 4, 4]), 10) == 3
    assert packing.lower_bound(np.array([4, 4, 4]), 10) == 2


def brute_components(rows, width=2, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                label[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return Counter((i, len(s), least.get(top(k)) if s else i, (least.get(top(k)) if s else i) == i) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def near_chain(spark):
    """A base text, copies with 1 to 12 of 100 words changed, and a chain whose ends are far apart."""
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(100)]
    rows, text = [], base[:]
    for k in range(60):
        w = base[:]
        for p in rng.choice(100, 1 + k % 12, replace=False):
            w[p] = f"n{k}x{p}"
        rows.append((1000 + k, " ".join(w)))
    for k in range(30):
        text = text[:]
        text[3 * k + 1] = f"c{k}"
        rows.append((2000 - k, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates(spark, odd, docs):
    for df in (odd, docs, near_chain(spark), empty(odd)):
        for width in (2, 5):
            got = near_dedup.near_duplicates(df, width=width).collect()
            assert Counter((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_components(pairs_of(df), width)


def test_connected_components(spark):
    links = [(k, k + 1) for k in range(200, 260)] + [(5, 9), (9, 7), (7, 5), (5, 5), (1, 300)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 200 for k in range(200, 261)}, 5: 5, 7: 5, 9: 5, 1: 1, 300: 1}
    for rounds in (1, 2):
        table = spark.createDataFrame(links + [(260, 5), (800, 801)], "a long, b long")
        early = connected_components(spark.createDataFrame(links, "a long, b long"), most_rounds=rounds)
        assert {r["node"]: r["label"] for r in refined(early, table).collect()} == {**{k: 5 for k in (*range(200, 261), 5, 7, 9)}, 1: 1, 300: 1, 800: 800, 801: 800}


def brute_repeats(rows, length=200):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(t[s : s + length] for _, t in data for s in range(len(t) - length + 1))
    out = []
    for k, t in data:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        out.append((k, len(t), tuple(map(tuple, edges.reshape(-1, 2).tolist())), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return Counter(out)


def passages(spark):
    """One passage of 50 to 400 bytes at many places, cut and joined in many ways, with multi-byte characters."""
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("abcdefé ñ"), 900))
    rows = []
    for k in range(80):
        a, n = int(rng.integers(0, 500)), int(rng.integers(100, 400))
        rows.append((k, "".join(rng.choice(list("xyz ü"), rng.integers(0, 300))) + passage[a : a + n] + "".join(rng.choice(list("xyz ü"), rng.integers(0, 300)))))
    return spark.createDataFrame(rows + [(100, "ab" * 400), (101, "a" * 260), (102, "c" + "ab" * 110)], "doc_id long, text string")


def test_suffix_dedup(spark, odd, docs):
    for df in (odd, docs, passages(spark), empty(odd)):
        for batches in (1, 5) if df is odd else (3,):
            got = suffix_dedup.remove_repeats(df, batches=batches).collect()
            assert Counter((r["id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in got) == brute_repeats(pairs_of(df))


def test_anchors_of_a_text_longer_than_a_segment(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 512)
    buf = np.frombuffer(np.random.default_rng(5).integers(97, 100, 3000).astype(np.uint8).tobytes() + b" ", np.uint8)
    runs = suffix_dedup.anchor_runs(buf, np.array([0, 3001]), 200)
    starts = np.concatenate([np.arange(p >> 16, (p >> 16) + (p >> 8 & 255)) for p in runs["place"]])
    assert starts.tolist() == list(range(3000 - 199))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, length=13):
    lower = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = lower(t)
        for s in range(max(1, len(w) - length + 1)) if w else ():
            windows[tuple(w[s : s + length])] |= {str(i)} if i is not None else set()
    out = []
    for k, t in rows:
        w, hit, held = lower(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    held |= windows[tuple(w[s : s + n])]
        out.append((k, len(w), len(hit), tuple(sorted(held)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_decontamination(spark, odd, docs):
    crafted = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1))
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df, items in ((odd, crafted), (docs, real), (empty(odd), crafted), (odd, empty(crafted))):
        want = brute_hits(pairs_of(df), [(r["item_id"], r["text"]) for r in items.collect()])
        got = decontamination.decontaminate(df, items).collect()
        assert Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == want


def test_decontamination_without_broadcast(spark, odd, monkeypatch):
    monkeypatch.setattr(decontamination, "small", lambda *a: False)
    got = decontamination.decontaminate(odd, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == brute_hits(pairs_of(odd), ITEMS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_format(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op2_chat_format(spark, SF).collect()}
    turns = defaultdict(list)
    for r in table.collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(turns)
    for k, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)), len(loss), sha(loss))


@pytest.mark.parametrize("hot", [1000, 1])
def test_chat_windows(spark, hot):
    """Conversations dealt over tasks, and conversations that each stay in one."""
    control = r"\ \\ <|turn|>x<|text|>y<|end|> <s></s> <<SYS>> [INST] \<|end|> <\|end|>"
    rows = [(1, 0, "system", "Be brief. " + control)] + [(1, k, ("assistant", "user")[k % 2], f"{k} {control} " * (k % 5 + 1)) for k in range(1, 60)]
    rows += [(2, None, None, None), (2, 0, "assistant", ""), (None, 3, "user<|text|>", "hi"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 1, "assistant", "word " * 500), (4, 2, "user", "after")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat_format.format_chats(df, target_tokens=120, history_tokens=60, fits=0, hot=hot)
    found = sorted(windows.collect(), key=lambda r: (r["conv"] or -9, r["window"]))
    back = {(r["conv"], r["window"]): r for r in chat_format.read_back(windows).collect()}
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] or -9, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by[r[0]].append((r[2] or "", r[3] or ""))
    for conv, want in by.items():
        own = [back[conv, r["window"]] for r in found if r["conv"] == conv]
        assert [tuple(t) for w in own for t in w["turns"]] == want
        assert [t for w in own for t in w["targets"]] == [t for role, t in want if role == "assistant"]
    long = [r for r in found if r["conv"] == 1]
    assert len(long) > 3 and all(r["n_repeated"] >= 1 and r["formatted"].startswith("<|turn|>system<|text|>Be brief.") for r in long[1:])
    assert any(r["n_repeated"] > 1 for r in long)
    assert empty(df).sparkSession and chat_format.format_chats(empty(df)).count() == 0


def test_chat_windows_are_the_same_either_way(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    made = [Counter(tuple(map(str, r)) for r in chat_format.format_chats(table, target_tokens=150, history_tokens=80, fits=0, hot=hot).collect()) for hot in (1, 30, 1000)]
    assert made[0] == made[1] == made[2]


def brute_base(text, window=8):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    covered = {k + j for k in range(len(w) - window + 1) if runs[tuple(w[k : k + window])] > 1 for j in range(window)}
    lines, seen = 0, set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_rules(spark, odd, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for df in (odd, docs, empty(odd)):
        got = quality_rules.quality_rules(df, labels).collect()
        assert Counter((r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == Counter((k, *brute_base(t)) for k, t in pairs_of(df))
        assert all(r["kept"] == (not r["base_failed"] and r["ratio"] >= -0.5) for r in got)
    assert all(r["ratio"] == 0 for r in quality_rules.quality_rules(docs, empty(labels)).collect())


def test_quality_ratio(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r[0] for r in labels.where("quality = 1").collect()}
    rows = pairs_of(docs)
    grams = lambda t: quality_rules._grams(np.frombuffer(t.encode(), np.uint8), 15) if len(t.encode()) > 2 else np.zeros(0, int)
    raw = sum((np.bincount(grams(t), minlength=1 << 15) for _, t in rows), np.zeros(1 << 15))
    trusted = sum((np.bincount(grams(t), minlength=1 << 15) for k, t in rows if k in good), np.zeros(1 << 15))
    weight = np.log((trusted + 0.5) / (trusted + 0.5).sum()) - np.log((raw + 0.5) / (raw + 0.5).sum())
    want = {k: weight[grams(t)].mean() for k, t in rows}
    assert all(abs(want[r["id"]] - r["ratio"]) < 1e-9 for r in quality_rules.quality_rules(docs, labels).collect())


def test_quality_ratio_counts_every_trusted_row(spark, monkeypatch):
    rows, good = 300_000, 250_000
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") < good).cast("int").alias("quality"))
    share = lambda n: (n + 0.5) / (n + 0.5 * (1 << 15))
    want = np.log(share(good) / share(rows))
    assert abs(quality_rules.quality_rules(docs, labels).first()["ratio"] - want) < 1e-9
    monkeypatch.setattr(quality_rules, "BROADCAST_BYTES", 0)  # joined by shuffle
    assert abs(quality_rules.quality_rules(docs, labels).first()["ratio"] - want) < 1e-9


def test_quality_classifier(spark, odd):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op9_quality_classifier(spark, sf).collect()}
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[k]["predicted"], y) for k, y in labels.items() if got[k]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.9
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.quality_model(spark, docs, sf)
    scores = quality_classifier.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert quality_classifier.score(empty(odd), model).count() == 0
    none = quality_classifier.train(odd, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    assert none is None and {r["score"] for r in quality_classifier.score(odd, none).collect()} == {1.0}


def test_gradients():
    rng = np.random.default_rng(6)
    x, bounds, y = rng.normal(size=(30, 5)), np.array([0, 3, 4, 12, 30]), np.array([0, 1, 1, 0])
    model = quality_classifier.fit(x, bounds, y, encoding=4, gates=3, steps=300)
    assert ((model.scores(x, bounds) > 0.5) == y).all()
    one = quality_classifier.Model(model.centre, model.scale, model.weights)
    assert np.allclose(one.scores(x[:3], np.array([0, 3])), model.scores(x, bounds)[:1])


def test_license_scan(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = license_scan.train(docs)
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    for r, (_, text) in zip(license_scan.scan_licenses(docs.select("doc_id", "text"), model).collect(), pairs_of(docs)):
        want = [lines[x] for x in text.split("\n") if x in lines]
        assert [f["family"] for f in r["findings"]] == want
        worded = [bool(re.search(r"\w", x)) for x in text.split("\n")]
        assert r["n_lines"] == sum(worded)
        assert r["n_paragraphs"] == sum(x and not y for x, y in zip(worded, [False, *worded]))
        assert all(f["confirmed"] for f in r["findings"])
        for f in r["findings"]:
            assert text.encode()[f["start"] : f["end"]].decode() in lines
    odd_lines = spark.createDataFrame([(1, "Licensed under the Frobnitz Shareware License, Version 7.0.\nplain words here")], "doc_id long, text string")
    assert [f["family"] for f in license_scan.scan_licenses(odd_lines, model).first()["findings"]] == ["unknown"]
    assert license_scan.scan_licenses(odd, model).count() == odd.count()
    assert license_scan.scan_licenses(empty(odd), license_scan.train(empty(odd))).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_license_scan_of_wrapped_notices(spark):
    model = license_scan.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    long_line = "Some words first. Released under the MIT License. The data files are something else. Licensed under CC BY 4.0. And more words follow."
    cases = {MIT: ["mit"], BSD: ["bsd"], GPL: ["gpl"], long_line: ["mit", "cc-by"], "\n\n".join((MIT, BSD, "Plain text of one line", GPL)): ["mit", "bsd", "gpl"]}
    rows = [*enumerate(cases), (9, "Released under the\n\nMIT License and more"), (10, "\n".join(["all the rights of the words", "that are not reserved for the"] * 50))]
    got = {r["id"]: r["findings"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, (text, want) in enumerate(cases.items()):
        assert [f["family"] for f in got[k]] == want, text
    assert got[0][0]["start"] == 0 and got[0][0]["end"] >= MIT.index("without restriction")
    assert [(f["start"], f["end"]) for f in got[1]] == [(0, len(BSD))]
    assert not {f["family"] for k in (9, 10) for f in got[k]} - {"unknown"}


def licence_by_plain_loops(model, line):
    """Findings of a paragraph of one line that is like no template: each sentence's classes by plain loops over its words and pairs."""
    hash_of = lambda words: [int(h) for h in license_scan.paragraph_grams([" ".join(words).encode()])["gram"]]
    told, best = {int(x) for x in model.told}, None
    for sentence in re.split(r"(?<=[.!?;])\s", line):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), sentence))
        grams = [hash_of([w])[0] for w in words] + [hash_of([a, b])[2] for a, b in zip(words, words[1:])]
        if not told.intersection(grams[len(words) :]):
            continue
        z = []
        for c in range(len(model.bias)):
            total = sum(float(model.weights[x >> (64 - model.bits), c]) for x in grams)
            z.append((total / len(grams) ** 0.5 + float(model.bias[c])) / model.temperature)
        p = [np.exp(x - max(z)) for x in z]
        p = [x / sum(p) for x in p]
        if best is None or p[0] < best[0]:
            best = p
    if best is None or 1 - best[0] < model.licence_from:
        return []
    k = 1 + int(np.argmax(best[1:-1]))
    return [(license_scan.FAMILIES[k - 1], best[k])] if best[k] >= model.named_from else [("unknown", 1 - best[0])]


def test_license_mentions(spark):
    model = license_scan.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    cases = {
        "available under the MIT licence": ["mit"], "GNU GPL version 2": ["gpl"], "under the terms of the GPL v3": ["gpl"],
        "published under Creative Commons BY 4.0": ["cc-by"], "This code is licensed under BSD": ["bsd"], "See LGPL v2.1": ["lgpl"],
        "licensed under the ISC licence": ["unknown"], "Distributed under the Boost Software License, Version 1.0": ["unknown"],
        "Eclipse Public License 2.0": ["unknown"], "Mit.": [], "I studied at MIT": [], "the license of the driver was lost": [],
        "public records of the general were lost": [], "free software is good": [], "": [],
        "Some words of a long line come first. They are available under the MIT licence. More of them follow after that sentence.": ["mit"],
    }
    rows = spark.createDataFrame([*enumerate(cases)], "doc_id long, text string")
    for r in license_scan.scan_licenses(rows, model).collect():
        text = [*cases][r["id"]]
        assert [f["family"] for f in r["findings"]] == cases[text], text
        assert not any(f["confirmed"] for f in r["findings"]) and r["n_paragraphs"] == r["n_lines"] == bool(text)


def test_license_scan_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = license_scan.train(docs)
    rng = random.Random(11)
    words = [w for r in docs.select("text").limit(40).collect() for w in (r[0] or "").split()[:30]]
    lines = []
    for _ in range(400):
        name = rng.choice([*(n for names in license_scan.NAMES.values() for n in names), rng.choice(words) + " License", "Zlib", "Artistic License 2.0"])
        parts = [*rng.sample(words, rng.randint(0, 6)), *rng.choice(license_scan.CARRIERS).format(name).split(), *rng.sample(words, rng.randint(0, 6))]
        if rng.random() < 0.4:
            rng.shuffle(parts)
        line = " ".join(parts)
        grams = license_scan.paragraph_grams([line.encode()])
        held = np.intersect1d(grams["gram"][~grams["first"]], model.vocabulary)
        near = any(len(np.intersect1d(held, t)) >= 0.3 * max(1, np.isin(model.vocabulary, t).sum()) for _, t in model.templates)
        lines += [] if near else [line]
    assert len(lines) > 150
    text = "\n\n".join(lines)
    row = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row["n_paragraphs"] == row["n_lines"] == len(lines)
    got = {text.encode()[f["start"] : f["end"]].decode(): (f["family"], f["probability"]) for f in row["findings"]}
    wanted = {line: found[0] for line in lines if (found := licence_by_plain_loops(model, line))}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert len({v[0] for v in wanted.values()}) > 5 and len(wanted) < len(set(lines))
    assert all(abs(got[k][1] - wanted[k][1]) < 1e-4 for k in wanted)


def test_unknown_bound():
    z = lambda share: [0.0, np.log(share / (1 - share)), 0.0]
    free, notices = [z(0.5 + k / 500) for k in range(100)], [z(0.9 + k / 2000) for k in range(100)]
    bound = license_scan.unknown_bound(np.array(free + notices), np.array([0] * 100 + [1] * 100))
    assert abs(bound - np.quantile([0.5 + k / 500 for k in range(100)], 0.95)) < 1e-9
    strict = license_scan.unknown_bound(np.array(free + [z(0.55 + k / 2000) for k in range(100)]), np.array([0] * 100 + [1] * 100))
    assert strict < 0.56 and license_scan.unknown_bound(np.zeros((0, 3)), np.zeros(0, int)) == 0.5


def test_byte_shards(odd, docs):
    for df in (odd, docs, empty(odd)):
        texts = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        size = F.octet_length("text") + 1
        for whole in (0.01, 1.0):
            rows = sharding.byte_shards(texts, F.md5("text"), size, shards=4, whole_groups_up_to=whole).collect()
            assert Counter((r["id"], r["size"]) for r in rows) == Counter((k, len((t or "").encode()) + 1) for k, t in pairs_of(df))
            total = sum(r["size"] for r in rows)
            for s in {r["shard"] for r in rows}:
                own = [r for r in rows if r["shard"] == s]
                assert sorted(r["slot"] for r in own) == list(range(len(own)))
                assert abs(sum(r["size"] for r in own) - total / 4) <= max(r["size"] for r in rows) + whole * total / 4
            order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
            assert [r["grp"] for r in order] == sorted(r["grp"] for r in order)


def test_queries_have_their_columns(spark):
    want = {
        "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op2_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op4_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op5_near_dedup": "doc_id n_shingles component_id kept",
        "op6_license_scan": "doc_id families",
        "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard",
        "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op9_quality_classifier": "doc_id held_out score predicted",
        "op10_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op11_lexical_search": "item_id rank doc_id score",
        "op12_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
        "op13_document_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    }
    assert set(want) == set(queries.QUERIES)
    for name, columns in want.items():
        assert set(columns.split()) <= set(queries.QUERIES[name](spark, SF).columns), name


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_hashes_tell_texts_that_collide_modulo_powers_of_two(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    texts = spark.createDataFrame([(1, f"{word} x {other} x"), (2, f"{word} x"), (3, f"{other} x")], "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(texts, width=2).collect()}
    assert got == {1: (3, 1), 2: (1, 2), 3: (1, 3)}


def test_packing_of_very_long_gaps(spark):
    rows = [(1, " " * 2_000_000), (2, "a" + "\n" * 1_000_000 + "b"), (3, "plain text"), (4, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bins, bound = check_packing(df, queries.packed_pieces(df))
    assert bound <= bins <= bound + 1


def test_near_duplicates_of_mixed_buckets(spark, monkeypatch):
    """Large buckets of several classes, with few members a task: a base with near copies, and relatives that are linked with some of them only."""
    rng = np.random.default_rng(8)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(150):
        w = base[:]
        for p in rng.choice(60, k % 14, replace=False):
            w[p] = f"n{k}x{p}"
        rows.append((k, " ".join(w)))
    linked = near_dedup._linked
    monkeypatch.setattr(near_dedup, "_linked", lambda *a: linked(*a, all_pairs_up_to=4, centres=1, per_task=7))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, width=2).collect())
    assert got == brute_components(rows, 2)


def test_slopes_equal_differences():
    rng = np.random.default_rng(9)
    x, bounds, y = rng.normal(size=(12, 5)), np.array([0, 3, 4, 12]), np.array([0.0, 1.0, 1.0])
    model = quality_classifier.fit(x, bounds, y, encoding=4, gates=3, steps=3)
    loss = lambda: -np.mean(y * np.log(s := model.forward(x, bounds)["score"]) + (1 - y) * np.log(1 - s))
    for name, slope in quality_classifier.slopes(model, x, bounds, y).items():
        weight = np.atleast_1d(model.weights[name])
        for k in np.ndindex(weight.shape):
            ends = []
            for step in (1e-5, -1e-5):
                moved = weight.copy()
                moved[k] += step
                model.weights[name] = moved.reshape(np.shape(slope))
                ends.append(loss())
            model.weights[name] = weight.reshape(np.shape(slope))
            assert abs((ends[0] - ends[1]) / 2e-5 - np.atleast_1d(slope)[k]) < 1e-7, name


def test_quality_threshold_from_trusted_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.quality_rules(docs, labels, threshold=None).collect()
    good = {r[0] for r in labels.where("quality = 1").collect()}
    own = sorted(np.floor(r["ratio"] * 1000) / 1000 for r in rows if r["id"] in good and not r["base_failed"])
    low, middle = own[int(np.ceil(0.01 * len(own))) - 1], own[int(np.ceil(0.5 * len(own))) - 1]
    bound = middle - 10 * max(middle - low, 0.001)
    assert all(r["kept"] == (not r["base_failed"] and r["ratio"] >= bound - 1e-12) for r in rows)
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.quality_rules(docs, empty(labels), threshold=None).collect())


def test_sharding_query(spark):
    rows = pairs_of(spark.read.parquet(f"{SF}/documents.parquet"))
    got = queries.op7_sharding(spark, SF).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None} and {r["shard"] for r in got} <= set(range(16))
    # brute force: all rows in the order of their texts' hashes and ids, whole small groups by their middle, other rows by their own
    order = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).digest(), r[0]))
    total, at, starts = sum(len((t or "").encode()) + 1 for _, t in rows), 0, {}
    placed = []
    for k, t in order:
        size = len((t or "").encode()) + 1
        first = starts.setdefault(t or "", [at, 0])
        first[1] += size
        placed.append((k, t or "", at, size))
        at += size
    shard = {}
    for k, t, before, size in placed:
        start, whole = starts[t]
        twice = 2 * start + whole if whole * 16 <= 0.01 * total else 2 * before + size
        shard[k] = min(15, twice * 16 // (2 * total))
    assert {r["doc_id"]: r["shard"] for r in got} == shard
