"""Queries of the report log where reports are saved again, compacted, looked up and summed up by hours, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score
from . import registry as rg
from . import reports as rp
from .registry import query
from .registry_store import stored_reports
from .rollup import RollUp

#: A report for each event; those of 50 and more are saved again with half of their score.
_TWICE = f"with r as (select event_id::varchar as message_id, event_id, ts as timestamp, event_type as word, case when value >= 50 then least(1.0, value / 100) / 2 else least(1.0, value / 100) end as s from events), q as (select *, {rg._TIER.format(x='s')} as tier, {rg._ACTION.format(x='s')} as action from r)"
_WEEK = "timestamp >= (select max(timestamp) - interval 7 day from q)"


def saved_twice(spark: SparkSession, sf_dir: str, shards: int = 0) -> rp.ReportTable:
    log = stored_reports(spark, sf_dir, "parquet", shards=shards)
    _save_again(log)
    return log


def _save_again(log: rp.ReportTable) -> None:
    rows = log.all().where("summary.highest_score >= 0.5")
    half = F.col("summary.highest_score") / 2
    tier, action = score.tier_of(half, rg.CONFIG.tiers), score.action_of(half, rg.CONFIG.tiers)
    summary = F.col("summary").withField("highest_score", half).withField("tier", tier).withField("action", action)
    pieces = log.pieces()
    ordered = rows.repartitionByRange(pieces, F.desc("timestamp")).sortWithinPartitions(F.desc("timestamp"))  # in another order than at first
    log.append(ordered.withColumn("summary", summary), pieces=pieces)


def week(log: rp.ReportTable):
    """The begin of the log's last seven days."""
    return F.lit(log.all().agg(F.max("timestamp")).first()[0]) - F.expr("interval 7 days")


@query(f"{_TWICE} select count(*) as total_messages, count(*) as total_detections, count(*) filter (where action = 'block') as blocked, count(*) filter (where action = 'flag') as flagged, round(avg(s), 2) as average_highest from q")
def report_stats_saved_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that is saved again counts once, with its last values."""
    return rp.stats(saved_twice(spark, sf_dir).reports().drop("processing_time_ms"))


@query(f"{_TWICE}, t as (select count(*) as total from q where tier = 'low') select message_id, total from (select * from q where tier = 'low' order by timestamp, message_id limit 50 offset 50), t")
def report_page_saved_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a tier, reports keep the place at which their id first came."""
    rows, total = saved_twice(spark, sf_dir).page(2, 50, "low")
    return rows.select("message_id", F.lit(total).cast("long").alias("total"))


@query(f"{_TWICE}, t as (select count(*) as kept from q) select message_id, tier, kept from (select * from q where tier = 'low' order by timestamp, message_id limit 50 offset 50), t")
def report_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After compaction the log has one row a report, in the same order."""
    log = saved_twice(spark, sf_dir, shards=8)
    log.compact()
    rows, _ = log.page(2, 50, "low")
    return rows.select("message_id", "summary.tier", F.lit(log.all().count()).cast("long").alias("kept"))


@query(f"{_TWICE} select message_id, tier, round(s, 9) as highest, timestamp from q where event_id = (select max(event_id) from q)")
def report_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only one of the folders of each day is opened."""
    log = saved_twice(spark, sf_dir, shards=16)
    last = log.all().agg(F.max(F.col("message_id").cast("long"))).first()[0]
    return log.get(str(last)).select("message_id", "summary.tier", F.round("summary.highest_score", 9).alias("highest"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query(f"{_TWICE} select count(*) as total_messages, count(*) as total_detections, count(*) filter (where action = 'block') as blocked, count(*) filter (where action = 'flag') as flagged, round(avg(s), 2) as average_highest from q where {_WEEK}")
def report_rollup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days from hourly sums that were made before reports were saved again."""
    log = stored_reports(spark, sf_dir, "parquet")
    sums = RollUp(log)
    sums.build()
    _save_again(log)
    return sums.stats(week(log)).drop("average_processing_time_ms")


@query(f"{_TWICE} select word, count(*) as n from q where {_WEEK} group by 1 order by n desc, word limit 3")
def report_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = saved_twice(spark, sf_dir)
    sums = RollUp(log)
    sums.build()
    return sums.top_words(week(log), 3)
