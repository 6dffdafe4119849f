"""Search, tokenizer alignment and fingerprints against plain versions, on the small tables and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordshield.llm import lexical_search, order_minhash, queries, tokenizer_alignment
from wordshield.llm.kernels import mix

from .test_operators import ITEMS, LONG, ODD, SF, docs, empty, odd, pairs_of  # noqa: F401  (fixtures)

MEGABYTES = " ".join(f"word{k % 977} {k}" for k in range(150_000))
MORE = [(30, "▁ a▁b"), (31, " leading"), (32, "trailing  "), (33, "a  b\n\n\tc"), (34, "<s> x </s> <unk> <|endoftext|>"), (35, "x" * 50_000), (36, " " * 3000 + "x"), (37, "naïve ÅB σς 日本 😀 1e5"), (38, "\x00\x1c a\x85b"), (39, MEGABYTES)]


@pytest.fixture(scope="module")
def odder(spark):
    return spark.createDataFrame(ODD + MORE, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("id", "t0", "t1", "kind", "pair", "links", "item", "range", "edge", "terms")})


# --- search

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_search(docs_, items, k):
    found = [(i, Counter(_TERM.findall((t or "").translate(_LOWER)))) for i, t in docs_]
    number, total = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(_TERM.findall((t or "").translate(_LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in found:
            n = sum(c.values())
            m = 50 + (50 * n * number) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


@pytest.mark.parametrize(("shard_bytes", "block_rows", "k"), [(8 << 20, 500_000, 50), (2000, 5, 3)])
def test_search(spark, odder, docs, shard_bytes, block_rows, k):
    more = [(50, "wäre Word5, word5; one!"), (51, "x"), (52, "none of these occurs zzz"), (53, LONG)]
    items = spark.createDataFrame(ITEMS + more, "item_id long, text string").withColumn("term", F.lit("clash"))
    for df in (odder, docs, empty(odder)):
        index = lexical_search.build_index(df, shard_bytes=shard_bytes)
        got = lexical_search.search(index, items, k=k, block_rows=block_rows, salts=3)
        lexical_search.drop_index(index)
        assert Counter((r["item"], r["rank"], r["id"], r["score"]) for r in got.collect()) == brute_search(pairs_of(df), ITEMS + more, k)
    index = lexical_search.build_index(docs)
    assert lexical_search.search(index, empty(items)).count() == 0


def test_search_query_equals_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got = queries.op11_lexical_search(spark, SF)
    want = db.sql(queries.ORACLE_SQL["op11_lexical_search"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.select(*got.columns).fetchall())


def test_top_places_keep_the_first_of_equal_scores():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 400):
        for k in (1, 3, 50):
            scores = rng.integers(0, 6, n)
            want = sorted((x for x in range(n) if scores[x] > 0), key=lambda x: (-scores[x], x))[:k]
            assert sorted(lexical_search.top_places(scores, k).tolist()) == sorted(want)


# --- alignment


def byte_table():
    """The byte that each character of a byte-level vocabulary stands for: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute_alignment(rows):
    import sentencepiece

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    decoded = byte_table()
    linked, out = Counter(), []
    for i, text in rows:
        groups, links = [], []
        if text:
            want = b" " + text.encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(decoded[c] for c in a.id_to_token(x)) for x in ids_a]
            names = [b.id_to_piece(x) for x in ids_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
            if b"".join(bytes_a) == want == b"".join(bytes_b):
                p = q = end_a = end_b = 0
                group = ([], [])
                while p < len(ids_a) or q < len(ids_b):
                    if end_a == end_b and group != ([], []):
                        groups.append(group)
                        group = ([], [])
                    if end_a <= end_b:
                        end_a += len(bytes_a[p])
                        group[0].append(ids_a[p])
                        p += 1
                    else:
                        end_b += len(bytes_b[q])
                        group[1].append(ids_b[q])
                        q += 1
                groups.append(group)
                ends_a, ends_b = np.cumsum([0, *map(len, bytes_a)]), np.cumsum([0, *map(len, bytes_b)])
                q = 0
                for p in range(len(ids_a)):
                    while ends_b[q + 1] <= ends_a[p]:
                        q += 1
                    j = q
                    while j < len(ids_b) and ends_b[j] < ends_a[p + 1]:
                        links.append((ids_a[p], ids_b[j]))
                        j += 1
        linked.update(links)
        out.append((i, groups, links))
    most = defaultdict(int)
    for (x, y), n in linked.items():
        most[y] = max(most[y], n)
    digest = lambda gs: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs).encode()).hexdigest() if gs else ""
    return Counter((i, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(ls), sum(linked[x] == most[x[1]] for x in ls), sum(linked[x] for x in ls), digest(gs)) for i, gs, ls in out)


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("window", "pairs_per_bucket"), [(1 << 16, 1_000_000), (7, 300)])
def test_alignment(odder, docs, window, pairs_per_bucket):
    small = odder.where("doc_id is null or doc_id not in (35, 36, 39)") if window == 7 else odder
    for df in (small, docs, empty(odder)):
        got = tokenizer_alignment.align(df, queries._two_vocabularies, window=window, pairs_per_bucket=pairs_per_bucket)
        assert Counter(tuple(r) for r in got.select("id", *ALIGNED).collect()) == brute_alignment(pairs_of(df))


# --- fingerprints


def brute_fingerprint(text, k, least, parts):
    word = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])
    odd_ = 0x9E3779B97F4A7C15
    names = [text[j : j + k] for j in range(len(text) - k + 1)] or ([text] if text else [])
    seen, listed = Counter(), defaultdict(list)
    for at, name in enumerate(names):
        if len(name) == k:
            h = int(order_minhash.kmer_hashes(np.array(list(map(ord, name)), np.uint32), k)[0])
        else:
            h = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        value = word(h * odd_ + seen[name])
        seen[name] += 1
        listed[value * parts >> 64].append((value, at))
    out = []
    for part in range(parts):
        t = 0x1234_5678
        for value, _ in sorted(sorted(listed[part])[:least], key=lambda x: x[1]):
            t = word(t * odd_ + value)
        out.append(max(t >> 32, 1) if listed[part] else 0)
    return out


def test_fingerprints_are_those_of_the_plain_definition():
    rng = np.random.default_rng(5)
    texts = ["", "a", "short", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 5, "ab" * 900, "日本語😀" * 70, *("".join(rng.choice(list("abc ed"), n)) for n in (12, 13, 100, 3000))]
    got = order_minhash.fingerprints(texts, 12, 2, 64)
    for text, row in zip(texts, got):
        assert row.tolist() == brute_fingerprint(text, 12, 2, 64)
    for k, least, parts in ((5, 3, 16), (8, 1, 1)):
        got = order_minhash.fingerprints(texts[:-1], k, least, parts)
        assert [r.tolist() for r in got] == [brute_fingerprint(t, k, least, parts) for t in texts[:-1]]


def test_fingerprints_follow_edits_and_order():
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("abcdefghij "), 20_000))
    blocks = [text[a : a + 100] for a in range(0, len(text), 100)]
    shuffled = "".join(blocks[x] for x in rng.permutation(len(blocks)))
    some = list(text)
    for at in rng.integers(0, len(text), 40):
        some[at] = "X"
    one, edit, moved, other = order_minhash.fingerprints([text, "".join(some), shuffled, text[::-1]], 12, 2, 64)
    like = order_minhash.likeness
    assert like(one, one) == 1 and like(one, other) == 0
    assert like(one, edit) > 0.85
    assert 0.2 < like(one, moved) < 0.7  # nearly the same k-mers, but half of the pairs in another order


def check_fingerprints(rows, got):
    key = lambda r: (r[0] is not None, r[0] or 0)
    by_text = {}
    for r in got:
        by_text.setdefault(r["id"], []).append(r)
    ordered = sorted(rows, key=key)
    assert Counter((r["id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    ids = Counter(i for i, _ in rows)
    for (i, t), (j, u) in zip(ordered, [*ordered[1:], *ordered[:1]]):
        if ids[i] == 1 and ids[j] == 1:  # otherwise the order among equal ids counts
            (r,) = by_text[i]
            changed = order_minhash.edited(t or "", u or "")
            assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            prints = order_minhash.fingerprints([t or "", changed, u or ""], 12, 2, 64)
            assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(order_minhash.as_text(x) for x in prints[:2])
            assert r["near_edited"] == order_minhash.likeness(prints[0], prints[1]) and r["near_next"] == order_minhash.likeness(prints[0], prints[2])


def test_document_fingerprints(spark, odder, docs):
    for df in (odder, docs, docs.repartition(7), empty(odder), odder.where("doc_id = 7")):
        check_fingerprints(pairs_of(df), order_minhash.document_fingerprints(df).collect())
    # a row repeated over several ranges, and equal texts
    many = spark.range(300).select(F.lit(5).alias("doc_id"), F.lit("the same text again, and again").alias("text"))
    got = order_minhash.document_fingerprints(many.repartition(5)).collect()
    assert len(got) == 300 and {(r["near_next"], r["near_edited"] < 1) for r in got} == {(1.0, True)} and len({r["fingerprint"] for r in got}) == 1


def test_edited():
    assert order_minhash.edited("abcdefgh", "XYZ") == "abcdefXY" and order_minhash.edited("abcdefgh", "X") == "abcdefX" and order_minhash.edited("abc", "X") == "abc" and order_minhash.edited("", "X") == ""
