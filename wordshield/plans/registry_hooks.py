"""Queries of delivery, the classifier hook, list rebuilds and the self check, with their DuckDB equivalents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..sources import lexicon as lx
from . import registry as rg
from .health import self_check
from .outbox import Outbox
from .registry import query, table
from .registry_store import listed, scratch
from .scan import scan


def _reluctant(report: str, attempt: int) -> None:
    """A receiver that takes reports of half the score and more at the second attempt, and full scores never."""
    score = json.loads(report)["summary"]["highest_score"]
    if score >= 1 or score >= 0.5 and attempt == 1:
        raise OSError(f"busy at attempt {attempt}")


@query(f"{rg._REPORTS} select message_id, s < 1 as sent, case when s >= 1 then 3 when s >= 0.5 then 2 else 1 end::bigint as tries, case when s >= 1 then 'OSError: busy at attempt 3' else '' end as error from q")
def webhook_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report is sent once; those that fail are tried three times."""
    out = Outbox(spark, scratch(spark, "outbox"), _reluctant, most=3).deliver(rg.event_reports(spark, sf_dir).select("message_id", "summary"))
    return out.select("message_id", "sent", "tries", F.coalesce("error", F.lit("")).alias("error"))


@query(rg.ORACLE_SQL["rule_detect"].replace("select message_id as id, coalesce(words, '') as words, case when hits > 0 then 100 else 0 end::int as score, coalesce(hits, 0)::int as hits", "select message_id as id, coalesce(hits, 0)::int as hits, case when coalesce(hits, 0) = 0 then 'answer ' || length(f.text) end as answer").replace("f as (select message_id,", "f as (select message_id, z.text,").replace("z as (select message_id,", "z as (select message_id, text,"))
def classifier_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier answers for the messages without rule hits alone."""
    messages = rg.conversations(spark, sf_dir)
    found = rules.rule_detect(messages, rg.words(spark))
    return rules.classify_rest(messages, found, lambda text: F.concat(F.lit("answer "), F.length(text))).select("id", "hits", "answer")


@query("select 'ok' as status, count(distinct lower(p_name)) as words, 0::bigint as detections from part")
def health_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The self check with the part names as its list."""
    found = self_check(spark, lx.Lexicon(listed(spark, sf_dir).entries.withColumn("enabled", F.lit(True))))
    return spark.createDataFrame([(found["status"], found["words"], found["detections"])], "status string, words long, detections long")


@query(f"with {rg.sql_messages()}, x as (select word, base_score, 1 as number from w union all select word, base_score / 2, 2 from w where word <> 'the'), h as (select number, message_id, count(*) as words from m, x where contains(n, word) group by 1, 2) select number, count(*) as messages, sum(words)::bigint as words from h group by 1")
def list_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists, one after the other: the second scan takes the first one's expressions with other data."""
    messages = rg.conversations(spark, sf_dir)
    out = []
    for number, lexicon in ((1, rg.word_list(spark)), (2, lx.Lexicon.of(spark, [{"word": w, "base_score": s / 2} for w, s in rg.WORDS if w != "the"]))):
        found = scan(messages, lexicon, rg.PLAIN, unique=True, keep=False).detections.where("method = 'exact'").select("message_id", "word").distinct()
        out.append(found.agg(F.count_distinct("message_id").alias("messages"), F.count("*").alias("words")).select(F.lit(number).alias("number"), "messages", "words"))
    return out[0].unionByName(out[1])
