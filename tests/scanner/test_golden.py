"""Adversarial messages with known outcomes (default word list)."""

import pytest

from wordshield.plans.scan import scan
from wordshield.sources.lexicon import DEFAULT_WORDS, Lexicon

CASES = [
    ("a n a l", [], 0, "low", "log"),
    ("a-n-a-l", [("anal", 0, 7, "separator_bypass", "a-n-a-l")], 1.0, "critical", "block"),
    ("4n4l", [("anal", 0, 4, "leetspeak", "4n4l")], 1.0, "critical", "block"),
    ("@n@l", [("anal", 0, 4, "leetspeak", "@n@l")], 1.0, "critical", "block"),
    ("annnnal", [("anal", 0, 6, "repetition", "annnnal")], 0.975, "high", "warn"),
    ("аnаl", [("anal", 0, 4, "homoglyph", "аnаl")], 0.9, "high", "warn"),
    ("ＡＮＡＬ", [("anal", 0, 4, "exact", "anal")], 0.75, "medium", "flag"),
    ("a n n n a a l", [("anal", 0, 6, "repetition", "annnaal")], 0.7429, "medium", "flag"),
    ("4-n-4-l", [("anal", 0, 4, "leetspeak", "4n4l")], 1.0, "critical", "block"),
    ("@n@n@a@l", [], 0, "low", "log"),
    ("harass!!!", [("ass", 3, 6, "exact", "ass"), ("harass", 0, 6, "exact", "harass")], 0.75, "medium", "flag"),
    ("soooo basic", [("ass", 6, 8, "repetition", "bas")], 0.975, "high", "warn"),
    ("drrugs kiill", [("kill", 7, 12, "fuzzy", "kiill")], 0.825, "high", "warn"),
    ("k.i.l.l the b0mb", [("bomb", 12, 16, "homoglyph", "b0mb"), ("kill", 0, 7, "separator_bypass", "k.i.l.l"), ("bomb", 12, 16, "fuzzy", "b0mb")], 1.0, "critical", "block"),
    ("m&th lab in the old town house", [("meth", 0, 4, "leetspeak", "m&th")], 0.8, "medium", "flag"),
    ("c&nt and bu11y", [("bully", 9, 14, "homoglyph", "bu11y")], 0.8, "medium", "flag"),
    ("anla here", [], 0, "low", "log"),
    ("terorrist attack in the big city today", [("terrorist", 0, 9, "fuzzy", "terorrist")], 0.6857, "medium", "flag"),
    ("marijunaa", [("marijuana", 0, 9, "fuzzy", "marijunaa")], 0.9, "high", "warn"),
    ("you are a b.i.t.c.h and a bitch", [("bitch", 26, 31, "exact", "bitch")], 0.5714, "low", "log"),
    ("méth in the house", [("meth", 0, 4, "homoglyph", "méth"), ("meth", 0, 4, "fuzzy", "méth")], 0.75, "medium", "flag"),
    ("glass-hit", [("ass", 2, 5, "exact", "ass"), ("shit", 4, 9, "separator_bypass", "s-hit")], 1.0, "critical", "block"),
    ("!!!", [], 0, "low", "log"),
    ("   ", [], 0, "low", "log"),
    ("killing time", [("kill", 0, 4, "exact", "kill")], 0.75, "medium", "flag"),
]


@pytest.fixture(scope="module")
def reports(spark):
    rows = [(str(k), c[0]) for k, c in enumerate(CASES)]
    result = scan(spark.createDataFrame(rows, "message_id string, text string"), Lexicon.of(spark, DEFAULT_WORDS))
    return {int(r["message_id"]): r for r in result.reports.collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(reports, k):
    text, found, highest, tier, action = CASES[k]
    report = reports[k]
    got = [(d["word"], d["start"], d["end"], d["method"], d["matched_form"]) for d in report["detections"]]
    assert sorted(got) == sorted(found), text
    assert abs(report["summary"]["highest_score"] - highest) < 1e-4
    assert (report["summary"]["tier"], report["summary"]["action"]) == (tier, action)


def test_homoglyph_pairs(reports):
    assert reports[5]["detections"][0]["homoglyphs_detected"] == [["а", "a"], ["а", "a"]]
