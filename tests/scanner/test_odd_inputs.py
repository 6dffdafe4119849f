"""Queries against their SQL on inputs that the tables lack."""

import random
from dataclasses import replace

import duckdb
import pytest

from wordshield.config import Config
from wordshield.operators import stages
from wordshield.plans import registry, registry_log, reports
from wordshield.plans.scan import scan
from wordshield.sources.lexicon import Lexicon

from .test_scan import LIST, disguised


def against_sql(spark, name, folder, tables):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in tables:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = db.sql(registry.ORACLE_SQL[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    clean = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else str(x) for x in r]) for r in rows)
    return clean(tuple(r[c] for c in order) for r in got.collect()), clean(want.select(*(f'"{c}"' for c in order)).fetchall())


def test_marks_beside_letters_that_are_not_ascii(spark, tmp_path):
    texts = ["the", "éthe", "theé", "x́the", "THıNG thing", "日the本", "the_", "the1", "NICHT!", "the thething the", None, ""]
    spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = against_sql(spark, "highlight", tmp_path, ["conversations"])
    assert got == want and any("é\U0001f534the" in r for r in got)


def test_a_long_list_is_not_searched_again_in_each_message(spark):
    rng = random.Random(7)
    texts = [disguised(rng) for _ in range(150)] + ["thе the", "the thе x", "kill kіll", "analanal", "", None]
    messages = spark.createDataFrame([(str(k), t) for k, t in enumerate(dict.fromkeys(texts))], "message_id string, text string").cache()
    listed = Lexicon.of(spark, [{"word": w, "base_score": round(0.3 + 0.02 * k, 2), "tags": [w]} for k, w in enumerate([*LIST, "the", "a\nb"])])
    rows = lambda df: sorted(repr((r["message_id"], sorted(map(repr, r["detections"])), r["summary"])) for r in df.collect())
    for config, tags in ((registry.PLAIN, False), (replace(registry.PLAIN, case_sensitive=True), True), (Config(), True)):
        got, want = (scan(messages, listed, config, variant=v, with_tags=tags, unique=True, keep=False).reports for v in ("anchor", "rows"))
        assert rows(got) == rows(want)
    plan = scan(messages, listed, registry.PLAIN, variant="anchor", unique=True, keep=False).reports._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan.replace("split(text", "") and "regexp_instr" not in plan  # no pattern is compiled for a message


@pytest.mark.parametrize("name", ["report_rollup_words", "report_compacted", "report_rollup_stats"])
def test_a_log_is_dealt_over_tasks_by_its_rows(spark, monkeypatch, tmp_path, name):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(reports, "TASK_ROWS", 100)
    got, want = against_sql(spark, name, tmp_path, ["events"])
    assert got == want
    if name == "report_compacted":
        log = registry_log.saved_twice(spark, str(tmp_path))
        assert log.reports().rdd.getNumPartitions() == log.pieces() >= log.all().count() / 100


def test_repeated_matches_cover_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "PIECE_BYTES", 100)
    texts = ["the ent tion", "the thing the ent", "tionent", "the tion x", "parapara the", None, "", "the the "]
    spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = against_sql(spark, "dedup_detections", tmp_path, ["conversations"])
    assert got == want and any("'0-0'" in r and "'3'" in r for r in got)
