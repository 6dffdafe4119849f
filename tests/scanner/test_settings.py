"""Options of single messages, what reports carry, settings files, logging, and the distance for doubled letters."""

import io
import json

import pytest
from pyspark.sql import functions as F

from wordshield import logs
from wordshield.config import Config, Fuzzy
from wordshield.operators import fuzzy
from wordshield.plans import reports as rp
from wordshield.plans.scan import scan
from wordshield.sources.lexicon import DEFAULT_WORDS, Lexicon

OPTIONS = "named_struct('fuzzy', true, 'leetspeak', false, 'homoglyph', false, 'separator_bypass', false, 'repetition', false, 'max_distance', {})"


@pytest.mark.parametrize("variant", ["auto", "split"])
def test_a_message_may_ask_for_more_or_less_distance(spark, variant):
    rows = " union all ".join(f"select '{d}' as message_id, 'intrnationlze haraxs' as text, {OPTIONS.format(d)} as options" for d in (0, 1, 2, 3))
    found = scan(spark.sql(rows), Lexicon.of(spark, ["internationalize", "harass"]), variant=variant, keep=False).detections.collect()
    got = {(r["message_id"], r["word"], r["distance"]) for r in found if r["method"] == "fuzzy"}
    assert got == {("1", "harass", 1), ("2", "harass", 1), ("3", "harass", 1), ("3", "internationalize", 3)}


def test_distance_for_doubled_letters(spark):
    def of(a, b, kind):
        return spark.range(1).select(fuzzy.distance_of(F.lit(a), F.lit(b), F.lit(2), kind)).first()[0]

    want = {("mmal", "mammal"): (2, 1), ("kill", "killl"): (1, 0), ("anla", "anal"): (2, 2), ("anxl", "anal"): (1, 1), ("harss", "harass"): (1, 1), ("abcd", "wxyz"): (-1, -1)}
    assert {k: (of(*k, "edits"), of(*k, "doubled")) for k in want} == want
    df = spark.createDataFrame([("1", "mmal")], "message_id string, text string")
    near = lambda kind: scan(df, Lexicon.of(spark, ["mammal"]), Config(fuzzy=Fuzzy(distance_ratio=0.2, distance=kind)), keep=False).detections.count()
    assert (near("edits"), near("doubled")) == (0, 1)


def test_reports_carry_context_and_time(spark, tmp_path):
    df = spark.sql("select '1' as message_id, 'kill it' as text, timestamp'2024-01-01 10:00:00' as timestamp, map('user', 'u1') as context union all select '', 'fine', timestamp'2024-01-02 10:00:00', null")
    reports = scan(df, Lexicon.of(spark, ["kill"]), keep=False).reports
    seen = []
    for form in ("parquet", "json"):
        log = rp.ReportTable(spark, str(tmp_path / form), hooks=(lambda rows: seen.append({(r["timestamp"], r["context"]) for r in rows.collect()}),), form=form)
        log.append(reports, processing_time_ms=1.5)
        stored = {(r["timestamp"], r["context"]) for r in log.all().collect()}
        assert len(stored) == 2 and seen[-1] == stored and {c for _, c in stored} == {'{"user":"u1"}', None}
        assert rp.stats(log.all()).first()["average_processing_time_ms"] == 1.5
        page, total = log.page(1, 1)
        assert total == 2 and page.count() == 1
    assert json.loads(next((tmp_path / "json").glob("day=*/part*")).read_text().splitlines()[0])["text"] in ("kill it", "fine")


def test_settings_tree(tmp_path):
    (tmp_path / "c.yaml").write_text("server: {port: 1}\ndetection:\n  max_message_length: 50\n  repetition: {collapse_threshold: 3}\n  fuzzy: {max_checks_per_message: 7}\n  scoring:\n    tiers:\n      - {threshold: 0.3, label: low, action: log}\nword_list: {max_words: 5, default_path: words.txt}\nreporting: {retention_days: 3}\nlogging: {level: debug, format: json}\n")
    c = Config.load(str(tmp_path / "c.yaml"))
    assert (c.max_message_length, c.repetition.threshold, c.fuzzy.max_checks, len(c.tiers), c.max_words, c.word_list_path) == (50, 3, 7, 1, 5, "words.txt")
    (tmp_path / "d.yaml").write_text("detection: {scoring: {tier_mode: documented}}\n")
    assert Config.load(str(tmp_path / "d.yaml")).severities[-1].threshold == 0.8
    assert (c.reporting.retention_days, c.logging.level, c.logging.format) == (3, "debug", "json")


def test_limits_and_configured_list(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("1", "kill")], "message_id string, text string")
    for variant in ("auto", "rows", "shingle"):
        with pytest.raises(ValueError):
            scan(df, Lexicon.of(spark, DEFAULT_WORDS), Config(max_words=3), variant=variant)
    (tmp_path / "w.txt").write_text("alpha\n# no\nbeta\n")
    monkeypatch.setenv("WORD_LIST_PATH", str(tmp_path / "w.txt"))
    words = Lexicon.configured(spark, Config.load("/none"))
    assert {r["word"] for r in words.entries.collect()} == {"alpha", "beta"} and words.has("ALPHA") and not words.has("x")


def test_logging():
    out = io.StringIO()
    logs.set_up("info", "json", out).info("said %s", 1)
    assert json.loads(out.getvalue())["message"] == "said 1"
    logs.set_up("warning", "text", out).info("not said")
    assert "not said" not in out.getvalue()
