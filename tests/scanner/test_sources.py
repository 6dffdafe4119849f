"""Message sources, responses and the self check."""

import json

from wordshield.plans.health import self_check
from wordshield.plans.scan import scan
from wordshield.sources import messages as ms
from wordshield.sources.lexicon import Lexicon


def test_read_messages(spark, tmp_path):
    rows = [("1", "kill"), ("2", None)]
    df = spark.createDataFrame(rows, "id string, body string")
    for form in ("parquet", "json", "csv"):
        writer = df.write.option("header", True)
        writer.format(form).save(str(tmp_path / form))
        got = ms.read_messages(spark, str(tmp_path / form), form, "id", "body").orderBy("message_id").collect()
        assert [tuple(r) for r in got] == rows
    (tmp_path / "first.csv").write_text("any name,other\nkill it,1\n,2\nfine,3\n")
    assert {r["text"] for r in ms.read_first_column(spark, str(tmp_path / "first.csv")).collect()} == {"kill it", "fine"}


def test_checked(spark):
    df = spark.createDataFrame([("1", "kill"), ("2", None), ("3", ""), ("4", "x" * 11)], "message_id string, text string")
    good, bad = ms.checked(df, 10)
    assert [r["message_id"] for r in good.collect()] == ["1"]
    assert {r["message_id"]: r["error"] for r in bad.collect()} == {"2": "empty text", "3": "empty text", "4": "over 10 characters"}
    out = ms.responses(scan(good, Lexicon.of(spark, ["kill"]), keep=False).reports).first()
    assert json.loads(out["response"])["detections"][0]["word"] == "kill"


def test_self_check(spark):
    assert self_check(spark, Lexicon.of(spark, ["kill"])) == {"status": "ok", "words": 1, "detections": 0}
