"""Scanning message streams: the batch scan on each micro-batch, de-duplication and live statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.scan import scan
from ..sources.lexicon import Lexicon


def unique_messages(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream without rows that repeat a message_id within the delay; rows later than that go."""
    stamped = messages.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return stamped.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["message_id"])


def scan_stream(messages: DataFrame, lexicon: Callable[[], Lexicon], path: str, checkpoint: str, config: Config | None = None, every: str | None = None) -> StreamingQuery:
    """Start writing the reports of a stream (message_id, text[, timestamp, context, options]) to path, one folder a micro-batch.

    The list is read again for each micro-batch, so changes take effect; a repeated micro-batch overwrites its folder. A
    message's timestamp goes through the scan with it. every: how often to run, such as "10 seconds"; None ends with the backlog.
    """

    def each(batch: DataFrame, number: int) -> None:
        result = scan(batch, lexicon(), config, keep=False)
        result.reports.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_stats(reports: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by window and action of a stream of reports (timestamp, summary); slide makes windows overlap."""
    stamped = reports.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    return stamped.groupBy(F.window("timestamp", width, slide or width), F.col("summary.action").alias("action")).agg(F.count("*").alias("messages"))
