"""The report log: append, look up, page, aggregate, expire, export."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, NullType, StringType, StructField, StructType

from ..config import Config
from ..schemas import REPORT


#: Rows that one task sorts or writes. Reports of short texts take about half a kilobyte each there.
TASK_ROWS = 200_000
#: Bytes of log files that one task reads into a shuffle; they are compressed several times over.
TASK_BYTES = 32 << 20


def pieces_of(rows: int, size: int = 0) -> int:
    """Partitions for a number of reports and of bytes of files, so that no task's share grows with the log.

    Spark's own choice merges partitions by their compressed bytes, which for reports are a small part of what a sort holds.
    """
    return max(1, -(-rows // TASK_ROWS), -(-size // TASK_BYTES))


def newest(reports: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of reports, latest first; equal times by message id."""
    return reports.orderBy(F.desc("timestamp"), "message_id").offset(offset).limit(limit)


def of_tier(reports: DataFrame, tier: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the reports of one severity tier, in the order in which their ids first came; reports that aren't from a log, by time."""
    order = ["arrived.written", "arrived.nth"] if "arrived" in reports.columns else ["timestamp", "message_id"]
    return reports.where(F.col("summary.tier") == tier).orderBy(*order).offset(offset).limit(limit)


def current(reports: DataFrame, pieces: int | None = None) -> DataFrame:
    """The last report of each message id, in a number of partitions (see pieces_of; default: Spark's). A log's rows follow each other as they were written; others by time, and of equal times the one whose JSON hashes lowest counts."""
    mine = Window.partitionBy("message_id")
    reports = reports.repartition(pieces, "message_id") if pieces else reports
    if "written" not in reports.columns:
        order = [F.desc("timestamp"), F.xxhash64(F.to_json(F.struct(*reports.columns)))]
        return reports.withColumn("place", F.row_number().over(mine.orderBy(*order))).where("place = 1").drop("place")
    own = F.struct("written", "nth")
    last_first = mine.orderBy(F.desc("written"), F.desc("nth"))
    first = F.min(F.coalesce("arrived", own)).over(last_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = reports.withColumns({"place": F.row_number().over(last_first), "arrived": first})
    return placed.where("place = 1").drop("place")


def since(reports: DataFrame, cutoff: Column) -> DataFrame:
    return reports.where(F.col("timestamp") >= cutoff)


def stats(reports: DataFrame) -> DataFrame:
    """One row: reports, detections, blocked and flagged messages, mean score of the messages' highest, and mean processing time where reports have one."""
    action = F.col("summary.action")
    timed = [F.coalesce(F.round(F.avg("processing_time_ms"), 2), F.lit(0.0)).alias("average_processing_time_ms")] if "processing_time_ms" in reports.columns else []
    return reports.agg(
        F.count("*").alias("total_messages"),
        F.coalesce(F.sum("summary.total_detections"), F.lit(0)).alias("total_detections"),
        F.count_if(action == "block").alias("blocked"),
        F.count_if(action == "flag").alias("flagged"),
        F.coalesce(F.round(F.avg("summary.highest_score"), 2), F.lit(0.0)).alias("average_highest"),
        *timed,
    )


def top_words(reports: DataFrame, limit: int = 10, first_seen: bool = False) -> DataFrame:
    """The most detected words and their counts; equal counts by the word, or by the earliest report with it."""
    seen = [F.struct("timestamp", "message_id").alias("at")] if first_seen else []
    words = reports.select(*seen, F.explode("detections").alias("d")).withColumn("word", F.lower("d.word"))
    firsts = [F.min("at").alias("at")] if first_seen else []
    return words.groupBy("word").agg(F.count("*").alias("n"), *firsts).orderBy(F.desc("n"), *(["at"] if first_seen else []), "word").limit(limit).select("word", "n")


def windowed(reports: DataFrame, width: str = "1 hour") -> DataFrame:
    """Reports, detections and blocked messages by time window."""
    slots = reports.groupBy(F.window("timestamp", width).alias("w"))
    out = slots.agg(F.count("*").alias("messages"), F.sum("summary.total_detections").alias("detections"), F.count_if(F.col("summary.action") == "block").alias("blocked"))
    return out.select(F.col("w.start").alias("start"), "messages", "detections", "blocked")


@dataclass
class ReportTable:
    """Reports in Parquet or JSON lines, one folder a day, so time filters and expiry prune folders.

    Every append adds rows; a message id's report is its last row, and every reader but all() gives one report an id. So an
    append that is repeated, as by a retried micro-batch, changes no answer. compact() rewrites the log without superseded rows.
    shards: also a folder for each hash of the message id, so that get() opens one folder a day. One writer at a time.
    """

    spark: SparkSession
    path: str
    config: Config = Config()
    hooks: tuple[Callable[[DataFrame], None], ...] = ()
    form: str = "parquet"
    shards: int = 0

    @staticmethod
    def configured(spark: SparkSession, config: Config, path: str = "./data/reports", **more) -> ReportTable:
        """At $REPORT_PATH as it was when config was loaded, else at path."""
        return ReportTable(spark, config.environment.get("REPORT_PATH", path), config, **more)

    def append(self, reports: DataFrame, processing_time_ms: float | None = None, pieces: int | None = None) -> None:
        """Add reports (message_id, text, normalized_text, detections, summary[, timestamp, context, processing_time_ms]), in their order.

        With shards, the rows are dealt over a number of tasks first: pieces, or as many as Spark takes. Without, each of the reports' own partitions is written by one task.

        Hooks get the rows as they were stored: they are read back, so nothing is scanned or stamped twice. A hook that fails is
        logged, and the next one runs.
        """
        number = uuid.uuid4().hex
        given = {"timestamp": F.current_timestamp(), "context": F.lit(None), "processing_time_ms": F.lit(processing_time_ms)}
        own = {"appended": F.lit(number), "written": F.lit(time.time_ns()), "nth": F.monotonically_increasing_id(), "arrived": F.lit(None)}
        full = reports.withColumns({k: v for k, v in given.items() if k not in reports.columns} | own)
        if not isinstance(full.schema["context"].dataType, (StringType, NullType)):
            full = full.withColumn("context", F.to_json("context"))
        self._write(full.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in REPORT)), self.path, pieces if self.shards else None)
        if self.hooks:
            stored = self.all().where(F.col("appended") == number).drop(*self._own())
            for hook in self.hooks:
                try:
                    hook(stored)
                except Exception:
                    logging.getLogger(__name__).warning("report hook failed", exc_info=True)

    def _shard(self, message_id: Column) -> Column:
        return F.pmod(F.xxhash64(message_id), F.lit(self.shards)).cast("int")

    def _write(self, rows: DataFrame, path: str, pieces: int | None = None, days: int = 1) -> None:
        """pieces: tasks that the rows are dealt over, by folder; the rows of one of about `days` days may take several."""
        folders = {"day": F.to_date("timestamp")} | ({"shard": self._shard(F.col("message_id"))} if self.shards else {})
        rows = rows.withColumns(folders)
        if pieces:
            parts = -(-pieces // (days * max(1, self.shards)))
            rows = rows.repartition(pieces, *folders, F.pmod(F.xxhash64("message_id", F.lit(1)), F.lit(parts)))
        elif self.shards:
            rows = rows.repartition(*folders)  # a file a folder
        writer = rows.write.mode("append").partitionBy(*folders).format(self.form)
        writer.option("parquet.bloom.filter.enabled#message_id", "true").save(path)

    def _own(self) -> list[str]:
        return ["day", "shard", "appended", "written", "nth", "arrived"]

    def all(self) -> DataFrame:
        """Every row of the log, superseded ones too."""
        schema = StructType([*REPORT.fields, StructField("day", DateType()), *([StructField("shard", IntegerType())] if self.shards else [])])
        return self.spark.read.schema(schema).format(self.form).load(self.path)

    def pieces(self) -> int:
        """How many partitions a shuffle of the log's rows takes: by the bytes of its files and, in Parquet, by the rows that their footers count."""
        fs, path = self._files()
        return pieces_of(self.all().count() if self.form == "parquet" else 0, fs.getContentSummary(path(self.path)).getLength())

    def reports(self) -> DataFrame:
        """One report for each message id."""
        return current(self.all(), self.pieces())

    def get(self, message_id: str) -> DataFrame:
        rows = self.all().where(F.col("message_id") == message_id)
        rows = rows.where(F.col("shard") == self._shard(F.lit(message_id))) if self.shards else rows
        return current(rows).drop(*self._own())

    def page(self, page: int = 1, size: int = 50, tier: str | None = None) -> tuple[DataFrame, int]:
        """A page, latest first or in order of arrival within a tier, and how many reports there are in all pages."""
        rows = self.reports()
        total = rows.where(F.col("summary.tier") == tier).count() if tier else rows.count()
        return (of_tier(rows, tier, size, (page - 1) * size) if tier else newest(rows, size, (page - 1) * size)), total

    def stats(self, hours: int = 24) -> DataFrame:
        return stats(self._recent(hours))

    def top_words(self, hours: int = 24, limit: int = 10) -> DataFrame:
        return top_words(self._recent(hours), limit, first_seen=True)

    def compact(self) -> None:
        """Rewrite the log with one row for each message id, which keeps its place in the order.

        New files stand beside the old ones for a moment, which changes no answer, since readers take one row an id.
        """
        old = self.all().inputFiles()
        pieces, days = self.pieces(), max(1, self.all().select("day").distinct().count())
        staged = f"{self.path}/_compact-{uuid.uuid4().hex}"
        names = [f.name for f in REPORT]
        self._write(current(self.all(), pieces).select(*names), staged, pieces, days)
        fs, Path = self._files()
        for file in self.spark.read.format(self.form).schema(REPORT).load(staged).inputFiles():
            source = Path(file)
            target = Path(file.replace(staged.rpartition("/")[2] + "/", "", 1))
            fs.mkdirs(target.getParent())
            fs.rename(source, target)
        for file in old:
            fs.delete(Path(file), False)
        fs.delete(Path(staged), True)

    def _files(self):
        """The file system of the log, and Path of the JVM. Only names pass through the driver."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _recent(self, hours: int) -> DataFrame:
        """Reports of the last hours. An id's last row counts, whatever the time of those before it, so all rows of the log are looked at, but of the columns only what the caller takes."""
        return since(self.reports(), F.current_timestamp() - F.make_dt_interval(hours=F.lit(hours)))

    def expire(self, days: int | None = None) -> int:
        """Delete the folders of days before the retention; returns how many. Zero or less keeps all.

        Whole days go, so a report of the first day that is kept may stay up to 24 hours longer.
        """
        days = self.config.reporting.retention_days if days is None else days
        if days <= 0:
            return 0
        old = [r["day"] for r in self.all().select("day").distinct().where(F.col("day") < F.date_sub(F.current_date(), days)).collect()]  # a row a day
        fs, path = self._files()
        for day in old:
            fs.delete(path(f"{self.path}/day={day}"), True)
        return len(old)

    def export(self, path: str, form: str = "json") -> None:
        """The newest reports (Config.reporting.export_limit) as JSON or Parquet."""
        newest(self.reports().drop(*self._own()), self.config.reporting.export_limit).write.mode("overwrite").format(form).save(path)


def post_each(send: Callable[[str], None]) -> Callable[[DataFrame], None]:
    """A hook that hands every report, as JSON, to send() in the tasks; a failure of one, whatever its kind, is logged and ignored."""

    def hook(reports: DataFrame) -> None:
        def partition(rows) -> None:
            for row in rows:
                try:
                    send(row["json"])
                except Exception:
                    logging.getLogger(__name__).debug("report not sent", exc_info=True)

        reports.select(F.to_json(F.struct("*")).alias("json")).foreachPartition(partition)

    return hook
