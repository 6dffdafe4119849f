"""Opt-in ways of the scan: separators across white space, fuzzy matching without a budget; delivery; carried columns; the doubled-letter distance by its rule."""

import functools
import json
import random

import pytest
from pyspark.sql import functions as F

from wordshield.config import Config, Fuzzy, Reporting, Separators, Stage
from wordshield.operators import fuzzy
from wordshield.plans import reports as rp
from wordshield.plans.outbox import Outbox
from wordshield.plans.rollup import RollUp
from wordshield.plans.scan import scan
from wordshield.sources import messages as ms
from wordshield.sources.lexicon import DEFAULT_WORDS, Lexicon, from_rows

from .test_golden import CASES


@pytest.mark.parametrize("variant", ["rows", "anchor"])
def test_separators_across_white_space(spark, variant):
    df = spark.createDataFrame([("1", "so a n a l it is"), ("2", "k - i\n l . l"), ("3", "a fine day")], "message_id string, text string")
    words = Lexicon.of(spark, DEFAULT_WORDS)
    found = scan(df, words, Config(separator_bypass=Separators(spans="message")), variant=variant, keep=False).detections.collect()
    got = {(r["message_id"], r["word"], r["start"], r["end"], r["matched_form"]) for r in found if r["method"] == "separator_bypass"}
    assert {("1", "anal", 3, 10, "a n a l"), ("2", "kill", 0, 12, "k - i\n l . l")} <= got and not [x for x in got if x[0] == "3"]
    plain = scan(df, words, keep=False).detections.where("method = 'separator_bypass'")
    assert plain.count() == 0 and any(text == "a n a l" and not want for text, want, *_ in CASES)


def plain_nearest(token, words):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            row, before = [i + 1], row
            for j, d in enumerate(b):
                row.append(min(before[j + 1] + 1, row[j] + 1, before[j] + (c != d)))
        return row[-1]

    near = [(distance(token, w), len(w), k, w) for k, w in enumerate(words) if abs(len(w) - len(token)) <= 2]
    near = [x for x in near if x[0] <= 2 and x[0] / x[1] <= 0.25]
    return min(near)[3] if near else None


def test_fuzzy_index_of_ten_thousand_words(spark):
    rng = random.Random(4)
    words = list(dict.fromkeys("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 11))) for _ in range(10_000)))
    tokens = list(dict.fromkeys([w[:k] + rng.choice("abcxyz") + w[k + rng.randint(0, 1) :] for w in rng.sample(words, 150) for k in (rng.randrange(len(w)),)] + ["", "a", "zzzzzzzz"]))
    listed = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, ord long")
    pairs = fuzzy.near_pairs(spark.createDataFrame([(t,) for t in tokens], "token string"), listed, Fuzzy()).collect()
    best = {}
    for r in pairs:
        best[r["token"]] = min(best.get(r["token"], (9,)), (r["distance"], len(r["word"]), r["ord"], r["word"]))
    assert {t: best.get(t, (None,))[-1] for t in tokens} == {t: plain_nearest(t, words) for t in tokens}


def test_scan_without_a_budget(spark):
    rng = random.Random(6)
    letters = "aeioulmnrst"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(900)]
    texts = [" ".join(w[:2] + "x" + w[3:] for w in rng.sample(words, 4)) for _ in range(20)] + [words[0], ""]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "message_id string, text string")
    free = Config(fuzzy=Fuzzy(max_checks=0))
    off = {"homoglyph": Stage(False), "separator_bypass": Stage(False)}
    got = scan(df, Lexicon.of(spark, words), free, unique=True, keep=False).reports.collect()
    budget = scan(df, Lexicon.of(spark, words), Config(fuzzy=Fuzzy(max_checks=1 << 20), **off), unique=True, keep=False).reports.collect()
    fuzzy_of = lambda rows: {(r["message_id"], d["matched_form"], d["word"], d["distance"]) for r in rows for d in r["detections"] if d["method"] == "fuzzy"}
    assert len(fuzzy_of(got)) > 40 and fuzzy_of(got) == fuzzy_of(budget)
    unlisted = list(dict.fromkeys(words))
    for r in got:
        for d in r["detections"]:
            if d["method"] == "fuzzy":
                assert d["word"] == plain_nearest(d["matched_form"], unlisted)


def test_distance_for_doubled_letters_by_its_rule(spark):
    """Each cell of the table: the plain three steps, or, where the last two letters are the other's swapped, one from the row just above, two places back."""

    def plain(a, b):
        if not a or not b:
            return max(len(a), len(b))

        @functools.cache
        def cell(i, j):
            if i == 0 or j == 0:
                return i + j
            other = a[i - 1] != b[j - 1]
            least = min(cell(i - 1, j) + 1, cell(i, j - 1) + 1, cell(i - 1, j - 1) + other)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                least = min(least, cell(i - 1, j - 2) + other)
            return least

        return cell(len(a), len(b))

    rng = random.Random(2)
    pairs = list({("".join(rng.choice("abc") for _ in range(rng.randint(0, 5))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))) for _ in range(400)})
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.distance_of(F.col("a"), F.col("b"), F.lit(2), "doubled").alias("d"))
    for a, b, d in df.collect():
        want = plain(a, b)
        assert d == (want if want <= 2 and abs(len(a) - len(b)) <= 2 else -1), (a, b)


def test_a_receiver_that_fails_twice_gets_every_report_once(spark, tmp_path):
    got = tmp_path / "got"
    got.mkdir()

    def send(report, attempt):
        if attempt < 3:
            raise OSError("busy")
        with open(got / json.loads(report)["message_id"], "a") as out:
            out.write("x")

    box = Outbox(spark, str(tmp_path / "box"), send)
    reports = spark.createDataFrame([(str(k), "text") for k in range(30)], "message_id string, text string")
    status = box.deliver(reports).collect()
    assert {(r["sent"], r["tries"], r["error"]) for r in status} == {(True, 3, None)} and len(status) == 30
    assert {p.name: p.read_text() for p in got.iterdir()} == {str(k): "x" for k in range(30)}
    box.deliver(reports)  # all sent: nothing more
    assert box.attempts().count() == 90
    log = rp.ReportTable(spark, str(tmp_path / "log"), hooks=(lambda rows: 1 / 0, Outbox(spark, str(tmp_path / "other"), send).hook()))
    log.append(scan(spark.createDataFrame([("new", "kill")], "message_id string, text string"), Lexicon.of(spark, ["kill"]), keep=False).reports)
    assert (got / "new").exists() and log.reports().count() == 1  # the first hook's failure ended nothing
    assert Outbox.configured(spark, Config()) is None and Outbox.configured(spark, Config(reporting=Reporting(webhook_url="http://localhost:9/x"))) is not None


def test_get_reads_one_folder_a_day(spark, tmp_path):
    log = rp.ReportTable(spark, str(tmp_path / "log"), shards=8)
    reports = scan(spark.createDataFrame([(str(k), "kill it") for k in range(50)], "message_id string, text string"), Lexicon.of(spark, ["kill"]), keep=False).reports
    log.append(reports)
    log.append(reports.where("message_id < '2'"))
    log.compact()
    assert log.all().count() == 50 and log.get("17").count() == 1
    plan = log.get("17")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    sums = RollUp(log)
    sums.build()
    log.append(reports.where("message_id = '3'").withColumn("summary", F.col("summary").withField("action", F.lit("log"))))
    begin = F.expr("current_timestamp() - interval 1 hour")
    want, have = (x.first().asDict() for x in (rp.stats(rp.since(log.reports(), begin)), sums.stats(begin)))
    assert want == have and want["total_messages"] == 50
    assert sums.top_words(begin).collect() == rp.top_words(rp.since(log.reports(), begin)).collect()


def test_messages_bring_options_and_context(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"message_id": "1", "text": "b0mb", "options": {"leetspeak": false, "homoglyph": false, "fuzzy": false}, "context": {"user": "u"}}\n{"message_id": "2", "text": "b0mb"}\n')
    read = ms.read_messages(spark, str(tmp_path / "m.json"), "json", carried=("options", "context"))
    rows = {r["message_id"]: r for r in scan(read, Lexicon.of(spark, ["bomb"]), keep=False).reports.collect()}
    assert rows["1"]["context"] == {"user": "u"} and not rows["1"]["detections"] and rows["2"]["detections"]
    read.write.parquet(str(tmp_path / "p"))
    assert ms.read_messages(spark, str(tmp_path / "p")).columns == ["message_id", "text", "options", "context"]


def test_ids_are_never_given_again(spark, tmp_path):
    one = Lexicon.of(spark, ["a1", "b1", "c1"])
    two = one.delete(["c1"]).add_many(from_rows(spark, [{"word": "d1"}]))
    assert {(r["word"], r["id"]) for r in two.entries.collect()} == {("a1", 1), ("b1", 2), ("d1", 4)}
    gone = two.clear()
    gone.save(str(tmp_path / "list"))
    again = Lexicon.load(spark, str(tmp_path / "list"), fill=False).add_many(from_rows(spark, [{"word": "e1"}]))
    assert [(r["word"], r["id"]) for r in again.entries.collect()] == [("e1", 5)]
    with pytest.raises(ValueError):
        two.add_many(from_rows(spark, [{"word": "x1"}]), max_words=3)
    wide = Lexicon.of(spark, ["ＦＵＬＬ"])
    assert wide.entries.first()["normalized"] == "full" and wide.get("　ＦＵＬＬ\t").count() == 1
