"""Streaming queries over the events, with their DuckDB equivalents: each stream is run to its end and its output read back.

The events arrive in quarters by event id, a micro-batch each: the third, the fourth, the first, the second. So the last two come
late. A micro-batch leaves out what the watermark rules out that the one before it worked with, and so does the SQL.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import stream
from . import registry as rg
from .registry import query
from .registry_store import scratch

#: Quarters of the events in the order in which they arrive.
ARRIVAL = (2, 3, 0, 1)
FILES = 4


def arriving(spark: SparkSession, sf_dir: str, folder: str, quarters: tuple[int, ...]) -> None:
    """Write quarters of the events' reports to a folder, one after the other, FILES files each."""
    reports = rg.event_reports(spark, sf_dir).withColumn("event", F.col("message_id").cast("long"))
    most = reports.agg(F.max("event")).first()[0]
    quarter = F.floor(F.col("event") * 4 / F.lit(most + 1))
    for k in quarters:
        reports.where(quarter == k).drop("event").repartition(FILES).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken by their time


def _source(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def _run(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Every micro-batch's changed windows, in a folder by its number."""
    each = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _last(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    last = Window.partitionBy("window", "action").orderBy(F.desc("batch"))
    rows = rows.withColumn("place", F.row_number().over(last)).where("place = 1")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "action", "messages")


_PORTIONED = f"{rg._REPORTS}, p as (select *, {[ARRIVAL.index(q) for q in range(4)]}[1 + floor(message_id::bigint * 4 / (select max(event_id) + 1 from events))::int] as portion from q), k as (select portion, max(timestamp) as newest from p group by 1), z as (select p.*, (select max(newest) - interval 1 day from k where k.portion < p.portion - 1) as mark from p)"
_SLIDING = f"{_PORTIONED}, s as (select *, unnest([time_bucket(interval 12 hours, timestamp), time_bucket(interval 12 hours, timestamp) - interval 12 hours]) as start from z) select start::timestamp as start, action, count(*) as messages from s where mark is null or start + interval 24 hours > mark group by 1, 2"


def sliding(spark: SparkSession, folder: str) -> DataFrame:
    return stream.live_stats(_source(spark, folder), "24 hours", "12 hours", "1 day")


@query(_SLIDING)
def stream_sliding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by action in overlapping windows; rows that are too late for a window aren't counted in it."""
    folder, out, checkpoint = (scratch(spark, n) for n in ("events", "windows", "checkpoint"))
    arriving(spark, sf_dir, folder, ARRIVAL)
    _run(sliding(spark, folder), out, checkpoint)
    return _last(spark, out)


@query(_SLIDING)
def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two runs: the second goes on from the first one's checkpoint."""
    folder, out, checkpoint = (scratch(spark, n) for n in ("events", "windows", "checkpoint"))
    arriving(spark, sf_dir, folder, ARRIVAL[:2])
    _run(sliding(spark, folder), out, checkpoint)
    arriving(spark, sf_dir, folder, ARRIVAL[2:])
    _run(sliding(spark, folder), out, checkpoint)
    return _last(spark, out)


@query(f"{rg._REPORTS} select word || '-' || strftime(timestamp, '%Y-%m-%d %H') as message_id, 1::bigint as kept from q group by 1")
def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with an id for each event type and hour: one of each stays, whichever micro-batches they come in."""
    folder, out, checkpoint = (scratch(spark, n) for n in ("events", "unique", "checkpoint"))
    arriving(spark, sf_dir, folder, ARRIVAL)
    name = F.concat(F.col("detections")[0]["word"], F.lit("-"), F.date_format("timestamp", "yyyy-MM-dd HH"))
    unique = stream.unique_messages(_source(spark, folder).withColumn("message_id", name).select("message_id", "timestamp"), "100000 hours")
    unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("message_id").agg(F.count("*").alias("kept"))
