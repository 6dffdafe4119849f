"""Reports after changes of the list equal those of a full scan; the anchor search equals plain search."""

import random

import pytest

from wordshield.config import Config, Fuzzy
from wordshield.operators.match import anchored, find_all
from wordshield.plans.rescan import rescan
from wordshield.plans.scan import scan
from wordshield.sources.lexicon import Lexicon, from_rows

from .test_scan import LIST, disguised


def seen(reports):
    rows = reports.select("message_id", "text", "detections", "summary").collect()
    return sorted(repr((r["message_id"], r["text"], sorted(map(repr, r["detections"])), r["summary"])) for r in rows)


@pytest.mark.parametrize(("seed", "budget"), [(1, 500), (2, 40)])
def test_reports_equal_a_full_scan_after_random_changes(spark, seed, budget):
    rng = random.Random(seed)
    texts = list(dict.fromkeys(disguised(rng) for _ in range(300))) + ["", None]
    messages = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "message_id string, text string").cache()
    config = Config(fuzzy=Fuzzy(max_checks=budget))
    old = Lexicon.of(spark, [{"word": w, "base_score": round(0.3 + 0.02 * k, 2)} for k, w in enumerate(LIST)])
    reports = scan(messages, old, config, unique=True, keep=False).reports.cache()
    new = old
    for _ in range(4):
        kind = rng.randrange(4)
        word = rng.choice(LIST)
        if kind == 0:
            new = new.delete([word])
        elif kind == 1:
            new = new.add_many(from_rows(spark, [{"word": "".join(rng.choice("abcdeilnostu") for _ in range(rng.randint(2, 7)))}]))
        elif kind == 2:
            new = new.update(word, base_score=rng.random())
        else:
            new = new.update(word, enabled=False)
    got = rescan(messages, reports, old, new, config, unique=True)
    assert seen(got.reports) == seen(scan(messages, new, config, unique=True, keep=False).reports)
    assert 0 < got.touched.count() < len(texts)
    got.release()
    # no change touches nothing; messages without a report are scanned
    same = rescan(messages, reports, old, old, config, unique=True)
    assert same.touched.count() == 0
    fewer = rescan(messages, reports.where("message_id < '2'"), old, old, config, unique=True)
    assert seen(fewer.reports) == seen(reports)


def test_options_that_reach_further_count(spark):
    rows = "select '1' as message_id, 'intrnationlze' as text, named_struct('fuzzy', true, 'leetspeak', false, 'homoglyph', false, 'separator_bypass', false, 'repetition', false, 'max_distance', 3) as options"
    messages = spark.sql(rows)
    old = Lexicon.of(spark, ["kill"])
    new = old.add_many(from_rows(spark, [{"word": "internationalize"}]))
    got = rescan(messages, scan(messages, old, keep=False).reports, old, new)
    assert [d["word"] for r in got.reports.collect() for d in r["detections"]] == ["internationalize"] and got.touched.count() == 1


def test_anchors(spark):
    rng = random.Random(5)
    words = list(dict.fromkeys("".join(rng.choice("abé😀-") for _ in range(rng.randint(1, 7))) for _ in range(400)))
    texts = ["".join(rng.choice("abé😀-") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None]
    patterns = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "pattern string, k int")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sorted(tuple(r) for r in find_all(df, "t", patterns, "anchor").select("id", "k", "at").collect())
    assert got == sorted((i, k, at) for i, t in enumerate(texts) if t for k, w in enumerate(words) for at in range(len(t)) if t.startswith(w, at))
    rows = anchored(patterns).collect()
    assert len(rows) == len(words) and all(r["pattern"].startswith(r["_gram"], r["_back"]) and len(r["_gram"]) == min(3, len(r["pattern"])) for r in rows)


def test_words_are_never_read_as_settings(spark):
    """A word is data: nothing in it is replaced by a setting's value."""
    messages = spark.createDataFrame([("1", "say ${spark.master} now"), ("2", "local[8] is fine")], "message_id string, text string")
    found = scan(messages, Lexicon.of(spark, ["${spark.master}", "it's", "a\\b"]), keep=False).detections.collect()
    assert {(r["message_id"], r["word"], r["method"]) for r in found} == {("1", "${spark.master}", "exact")}


def test_another_list_needs_no_other_plan(spark):
    messages = spark.createDataFrame([("1", "kill it")], "message_id string, text string")
    shown = []
    for words in (["kill"], ["quiet", "words"]):
        plan = scan(messages, Lexicon.of(spark, words), keep=False).reports._jdf.queryExecution().analyzed().toString()
        assert "kill" not in plan and "quiet" not in plan
        shown.append(len(plan))
    assert shown[0] == pytest.approx(shown[1], rel=0.01)
