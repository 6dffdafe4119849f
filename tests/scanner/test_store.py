"""Word lists, reports, rules, configuration and streams."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from wordshield.config import Config
from wordshield.operators import rules
from wordshield.plans import registry
from wordshield.plans import reports as rp
from wordshield.plans.scan import scan
from wordshield.sources import lexicon as lx
from wordshield.streaming import stream

SF = "/root/testdata/sf0.001"


def words_of(df):
    return [r["word"] for r in df.orderBy("ord").collect()]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n# no\n  Two \nONE\n")
    (tmp_path / "a.csv").write_text('word,base_score,tags\nkill,0.9,"a, b,"\n,0.5,x\nbad,zz,\nplain,,\n')
    (tmp_path / "b.csv").write_text("word\nsolo\n")
    (tmp_path / "a.json").write_text(json.dumps([{"word": "a"}, {"word": "b", "base_score": 0.7, "tags": ["t"], "enabled": False}, {"word": ""}]))
    (tmp_path / "b.json").write_text(json.dumps({"word": "single"}))
    assert words_of(lx.read_upload(spark, str(tmp_path / "a.txt"))) == ["one", "Two", "ONE"]
    assert words_of(lx.Lexicon.empty(spark).add_many(lx.read_txt(spark, str(tmp_path / "a.txt"))).entries) == ["one", "Two"]
    csv = lx.read_upload(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()
    assert [(r["word"], r["base_score"], r["tags"]) for r in csv] == [("kill", 0.9, ["a", "b"]), ("plain", 0.5, [])]
    assert words_of(lx.read_upload(spark, str(tmp_path / "b.csv"))) == ["solo"]
    rows = lx.read_upload(spark, str(tmp_path / "a.json")).orderBy("ord").collect()
    assert [(r["word"], r["base_score"], r["tags"], r["enabled"]) for r in rows] == [("a", 0.5, [], True), ("b", 0.7, ["t"], False)]
    assert words_of(lx.read_upload(spark, str(tmp_path / "b.json"))) == ["single"]
    with pytest.raises(ValueError):
        lx.from_rows(spark, [{"word": "x", "base_score": 2}])
    with pytest.raises(ValueError):
        lx.from_rows(spark, [{"word": "x"}] * 3, max_words=2)


def test_changes(spark, tmp_path):
    lexicon = lx.Lexicon.of(spark, ["One", "two"])
    more = lexicon.add_many(lx.from_rows(spark, [{"word": " ONE ", "base_score": 0.9}, {"word": "three"}, {"word": "Three", "base_score": 0.1}]))
    rows = more.entries.orderBy("ord").collect()
    assert [(r["word"], r["base_score"], r["id"]) for r in rows] == [("One", 0.9, 1), ("two", 0.5, 2), ("three", 0.1, 3)]
    changed = more.update("TWO", enabled=False, tags=["t"])
    assert words_of(changed.enabled()) == ["One", "three"] and changed.get("two").first()["tags"] == ["t"]
    assert words_of(changed.delete(["one"]).entries) == ["two", "three"] and words_of(changed.delete_by_id(3).entries) == ["One", "two"]
    assert changed.clear().count() == 0 and changed.get_by_id(2).first()["word"] == "two"
    assert words_of(changed.page(2, 2)) == ["three"]
    assert {r["word"] for r in changed.word_map().collect()} == {"one", "three"}  # enabled words only
    changed.save(str(tmp_path / "list"))
    again = lx.Lexicon.load(spark, str(tmp_path / "list"))
    assert again.count() == 3 + len(lx.DEFAULT_WORDS) and not again.get("two").first()["enabled"]


def test_reports(spark, tmp_path):
    seen = []
    table = rp.ReportTable(spark, str(tmp_path / "log"), hooks=(lambda df: seen.append(df.count()),))
    messages = spark.createDataFrame([("1", "kill it"), ("2", "fine"), ("3", "k1ll 4n4l")], "message_id string, text string")
    reports = scan(messages, lx.Lexicon.of(spark, lx.DEFAULT_WORDS), keep=False).reports
    table.append(reports.withColumn("timestamp", F.expr("current_timestamp() - interval 200 days")))
    table.append(reports)
    assert seen == [3, 3] and table.all().count() == 6 and table.get("1").count() == 1
    stats = table.stats(24).first()
    assert (stats["total_messages"], stats["blocked"]) == (3, 1)
    assert {r["word"] for r in table.top_words().collect()} == {"kill", "anal"}
    assert table.expire(0) == 0 and table.expire() == 1 and table.all().count() == 3
    table.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert rp.of_tier(table.all(), "critical").count() == 1
    sent = tmp_path / "sent"
    sent.mkdir()
    rp.post_each(lambda text: (sent / json.loads(text)["message_id"]).write_text(text))(table.all())
    assert {p.name for p in sent.iterdir()} == {"1", "2", "3"}


def test_rules(spark):
    messages = spark.createDataFrame([("1", "a n a l glass"), ("2", "hello"), ("3", None)], "message_id string, text string")
    words = lx.Lexicon.of(spark, ["anal", "ass"]).entries
    found = rules.rule_detect(messages, words)
    assert {r["id"]: (r["words"], r["score"]) for r in found.collect()} == {"1": (["anal", "ass"], 100), "2": ([], 0), "3": ([], 0)}
    answers = rules.classify_rest(messages, found, lambda text: F.concat(F.lit("safe: "), text))
    assert {r["id"]: r["answer"] for r in answers.collect()} == {"1": None, "2": "safe: hello", "3": None}


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("fuzzy:\n  enabled: false\n  max_distance: 1\nmax_message_length: 50\nother: 1\ntiers:\n  - {label: low, threshold: 0.0, action: log}\n")
    monkeypatch.setenv("CONFIG_PATH", str(tmp_path / "c.yaml"))
    monkeypatch.setenv("WORD_LIST_PATH", "/words")
    config = Config.load()
    assert (config.fuzzy.enabled, config.fuzzy.max_distance, config.fuzzy.max_checks, config.max_message_length, len(config.tiers)) == (False, 1, 500, 50, 1)
    assert config.environment == {"WORD_LIST_PATH": "/words"} and Config.load("/none") == Config(environment=config.environment)


def test_stream(spark, tmp_path):
    rows = [("1", "kill it", "2024-01-01 00:00:00"), ("1", "kill it", "2024-01-01 00:00:10"), ("2", "fine", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "message_id string, text string, t string").select("message_id", "text", F.col("t").cast("timestamp").alias("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("message_id string, text string, timestamp timestamp").parquet(str(tmp_path / "in"))
    query = stream.scan_stream(stream.unique_messages(source), lambda: lx.Lexicon.of(spark, ["kill"]), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    reports = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["message_id"], r["summary"]["total_detections"]) for r in reports.collect()} == {("1", 1), ("2", 0)}
    live = stream.live_stats(spark.readStream.schema(reports.schema).parquet(str(tmp_path / "out" / "batch=0")))
    counts = live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert {(r["action"], r["messages"]) for r in spark.table("live").collect()} == {(reports.where("message_id = 1").first()["summary"]["action"], 1), ("log", 1)}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in ("conversations", "documents", "pages", "events", "part"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    clean = lambda rows: sorted(repr([round(x, 9) if isinstance(x, float) else str(x) for x in r]) for r in rows)
    assert clean(tuple(r[c] for c in order) for r in got.collect()) == clean(want.select(*(f'"{c}"' for c in order)).fetchall())


def test_documents_are_scanned_whole(spark, tmp_path):
    rows = [(1, "x" * 9_998 + "thing" + "y" * 20_000 + "Para" + "nicht"), (2, "para " * 5_000), (3, "short thing"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.exact_scan_documents(spark, str(tmp_path)).select("doc_id", "word", "start").collect()]
    want = [(k, w, at) for k, t in rows if t for w in ("thing", "nicht", "para") for at in range(len(t)) if t.lower().startswith(w, at)]
    assert sorted(got) == sorted(want)
