"""The scan against a plain model on random disguised messages, its parts, and its edges."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wordshield.config import Config, Fuzzy, Stage
from wordshield.functions import text as tx
from wordshield.operators import fuzzy, score, stages
from wordshield.operators.match import find_all
from wordshield.plans.scan import scan
from wordshield.sources.lexicon import DEFAULT_WORDS, Lexicon

sys.path.insert(0, str(Path(__file__).parent))
import model  # noqa: E402

LIST = [*DEFAULT_WORDS, "x-y", "mammal", "zz top"]
ODD = "".join(["\r\r\r", "\n\n\n", "\x1c", " ", "\U0001f600", "é", "ß", "１", "ﬁ", "中", "|", "&", "1", "0"])


def disguised(rng):
    out = []
    for _ in range(rng.randint(1, 7)):
        w = rng.choice(LIST)
        kind = rng.randint(0, 7)
        if kind == 1:
            w = rng.choice("-._ *").join(w)
        elif kind == 2:
            w = "".join({"a": "4", "e": "3", "i": "1", "l": "1", "o": "0", "s": "$", "t": "7", "c": "&"}.get(c, c) if rng.random() < 0.7 else c for c in w)
        elif kind == 3:
            w = "".join(c * rng.choice((1, 1, 3, 4, 2)) for c in w)
        elif kind == 4:
            w = "".join({"a": "а", "e": "е", "o": "ο", "i": "ï"}.get(c, c) for c in w)
        elif kind == 5:
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice("abcdexyz") + w[k + rng.randint(0, 1) :]
        elif kind == 6:
            w = "".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(2, 9)))
        if rng.random() < 0.3:
            w = w.upper()
        out.append(w)
        out.append(rng.choice([" ", " ", ". ", "", "\n", rng.choice(ODD)]))
    return "".join(out)


@pytest.fixture(scope="module")
def messages():
    rng = random.Random(11)
    texts = [disguised(rng) for _ in range(1500)]
    texts += ["the abcd " * 400, "1" * 30 + " b|&1t&h", "a" * 10_001 + "kill", "|" * 12 + "l", "", "K", "anal" * 20, "é-a-n-a-l kill"]
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize("variant", ["auto", "split", "shingle", "trie"])
def test_scan_equals_the_model(spark, messages, variant):
    scores = {w: round(0.3 + 0.02 * k, 2) for k, w in enumerate(LIST)}
    lexicon = Lexicon.of(spark, [{"word": w, "base_score": s} for w, s in scores.items()])
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(messages)], "message_id string, text string")
    result = scan(df, lexicon, variant=variant)
    got = {int(r["message_id"]): r["detections"] for r in result.reports.collect()}
    result.release()
    assert len(got) == len(messages)
    for k, text in enumerate(messages):
        want = Counter((*x[:6], round(x[6], 9)) for x in model.scan(text, scores))
        mine = Counter((d["word"], d["matched_form"], d["start"], d["end"], d["method"], d["distance"], round(d["final_score"], 9)) for d in got[k])
        assert mine == want, repr(text)


def test_matchers_agree(spark, messages):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(messages[:300])], "k int, t string")
    patterns = spark.createDataFrame([(w,) for w in (*LIST, "aa", "a\\Eb", "$", "lll")], "pattern string")
    rows = [Counter(tuple(r) for r in find_all(df, "t", patterns, v).select("k", "pattern", "at").collect()) for v in ("split", "shingle", "trie")]
    assert rows[0] == rows[1] == rows[2]
    assert rows[0] == Counter((k, p, at) for k, t in enumerate(messages[:300]) for p in (*LIST, "aa", "a\\Eb", "$", "lll") for at in model.occurrences(t, p))


def test_options_and_config(spark):
    df = spark.sql("select 'a' as message_id, 'b0mb k.i.l.l marijunaa' as text, named_struct('fuzzy', false, 'leetspeak', null, 'homoglyph', false, 'separator_bypass', true, 'repetition', null, 'max_distance', cast(null as int)) as options union all select 'b', 'b0mb k.i.l.l marijunaa', named_struct('fuzzy', true, 'leetspeak', false, 'homoglyph', false, 'separator_bypass', false, 'repetition', false, 'max_distance', 1)")
    found = scan(df, Lexicon.of(spark, DEFAULT_WORDS), keep=False).detections.collect()
    assert {(r["word"], r["method"]) for r in found if r["message_id"] == "a"} == {("kill", "separator_bypass"), ("bomb", "leetspeak")}
    assert {(r["word"], r["method"]) for r in found if r["message_id"] == "b"} == {("bomb", "fuzzy")}
    plain = Config(homoglyph=Stage(False), fuzzy=Fuzzy(False))
    got = scan(df.drop("options"), Lexicon.of(spark, DEFAULT_WORDS), plain, keep=False).detections
    assert {r["method"] for r in got.collect()} == {"leetspeak", "separator_bypass"}


def test_edges(spark):
    df = spark.createDataFrame([(None, "kill"), ("", "kill"), ("1", None), ("1", "bomb"), ("1", "bomb")], "message_id string, text string")
    lexicon = Lexicon.of(spark, [{"word": "Kill", "tags": ["violence"]}, {"word": "bomb", "enabled": False}, {"word": "中文"}])
    result = scan(df, lexicon, with_tags=True, keep=False)
    rows = result.reports.collect()
    assert len(rows) == 3 and all(r["message_id"] for r in rows)
    assert [(r["word"], r["tags"]) for r in result.detections.collect()] == [("kill", ["violence"])]
    none = scan(df, Lexicon.empty(spark), keep=False).reports.collect()
    assert len(none) == 3 and all(r["summary"]["total_detections"] == 0 and r["summary"]["action"] == "log" for r in none)
    assert scan(df.where("false"), lexicon, keep=False).reports.count() == 0


def test_case_sensitive(spark):
    df = spark.createDataFrame([("1", "KILL it")], "message_id string, text string")
    found = scan(df, Lexicon.of(spark, ["kill"]), Config(case_sensitive=True), keep=False).detections.collect()
    assert [r["method"] for r in found] == ["separator_bypass"]


def test_text_functions(spark):
    one = lambda c, **v: spark.range(1).select(*(F.lit(x).alias(k) for k, x in v.items())).select(c).first()[0]
    assert one(tx.collapse_repeats(F.col("t")), t="aaab\r\r\rc\n\n\nd") == "aab\r\rc\n\n\nd"
    assert one(tx.collapse_repeats(F.col("t"), 1), t="aaabb") == "ab"
    assert one(tx.collapse_to_one(F.col("t")), t="aaab\r\r\rc\n\n\nd") == "ab\rc\nd"
    assert one(tx.word_count(F.col("t")), t="a\x1cb c　d  ") == 4
    assert one(tx.rule_form(F.col("t")), t="Hel-lo  WOOrld!") == "heloworld"
    assert one(tx.highlight(F.col("t"), F.array(F.lit("a.b"), F.lit("kill"))), t="KILL skill a.b axb") == "\U0001f534KILL\U0001f534 skill \U0001f534a.b\U0001f534 axb"
    assert one(tx.highlight(F.col("t"), F.array().cast("array<string>")), t="kill") == "kill"
    assert [tuple(x) for x in one(tx.alnum_tokens(F.col("t")), t="\U0001f600 ab, c1")] == [(2, "ab"), (6, "c1")]
    assert one(tx.normalize(F.col("t"), True), t="Ａ") == "A"
    long = one(tx.leet_expansions(1024)(F.col("t")), t="1" * 11)
    assert long == model.readings("1" * 11) and len(long) > 256


def test_fuzzy_ties_and_budget(spark):
    words = spark.createDataFrame([("harass", 0.5, 0), ("harasx", 0.5, 1)], "word string, base_score double, ord long")
    best = fuzzy.nearest_words(spark.createDataFrame([("harasz",)], "token string"), words, Fuzzy()).first()
    assert (best["word"], best["distance"]) == ("harass", 1)
    pairs = {("anla", "anal"): 2, ("anxl", "anal"): 1, ("harss", "harass"): 1}
    for (a, b), d in pairs.items():
        assert spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b), 2)).first()[0] == d


def test_documented_tiers(spark):
    values = [0.0, 0.2999, 0.3, 0.5999, 0.6, 0.7999, 0.8, 1.0]
    tiers = Config(tier_mode="documented").severities
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(score.tier_of(F.col("v"), tiers), score.action_of(F.col("v"), tiers)).collect()
    assert [tuple(r) for r in rows] == [("low", "log")] * 2 + [("medium", "flag")] * 2 + [("high", "warn")] * 2 + [("critical", "block")] * 2
    assert Config().severities == Config().tiers
    with pytest.raises(ValueError):
        Config(tier_mode="other")
    df = spark.createDataFrame([("1", "they kill " + "word " * 40)], "message_id string, text string")
    words = Lexicon.of(spark, [{"word": "kill", "base_score": 0.6}])
    got = [scan(df, words, c, keep=False).reports.first() for c in (Config(), Config(tier_mode="documented"))]
    assert [(r["summary"]["tier"], r["summary"]["action"], r["detections"][0]["tier"]) for r in got] == [("medium", "flag", "medium"), ("high", "warn", "high")]


def test_tiers(spark):
    values = [0.0, 0.5999, 0.6, 0.7999, 0.8, 0.9999, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(score.tier_of(F.col("v"), Config().tiers), score.action_of(F.col("v"), Config().tiers)).collect()
    assert [tuple(r) for r in rows] == [("low", "log"), ("low", "log"), ("medium", "flag"), ("medium", "flag"), ("high", "warn"), ("high", "warn"), ("critical", "block")]
    assert set(stages.METHOD.values()) == {"exact", "homoglyph", "separator_bypass", "leetspeak", "repetition", "fuzzy"}
