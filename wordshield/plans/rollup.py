"""Statistics of a report log from hourly partial sums, without reading its reports again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import ReportTable, current

_HOUR = "hour timestamp, messages long, detections long, blocked long, flagged long, highest double, milliseconds double, timed long"
_WORD = "hour timestamp, word string, n long"
_SUMS = ["messages", "detections", "blocked", "flagged", "highest", "milliseconds", "timed"]


def by_hour(reports: DataFrame) -> DataFrame:
    """Partial sums of reports by the hour of their time."""
    action = F.col("summary.action")
    return reports.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count("*").alias("messages"),
        F.coalesce(F.sum("summary.total_detections"), F.lit(0)).alias("detections"),
        F.count_if(action == "block").alias("blocked"),
        F.count_if(action == "flag").alias("flagged"),
        F.coalesce(F.sum("summary.highest_score"), F.lit(0.0)).alias("highest"),
        F.coalesce(F.sum("processing_time_ms"), F.lit(0.0)).alias("milliseconds"),
        F.count("processing_time_ms").alias("timed"),
    )


def words_by_hour(reports: DataFrame) -> DataFrame:
    words = reports.select(F.date_trunc("hour", "timestamp").alias("hour"), F.explode("detections").alias("d"))
    return words.groupBy("hour", F.lower("d.word").alias("word")).agg(F.count("*").alias("n"))


@dataclass
class RollUp:
    """Hourly sums and word counts kept beside a log, at its path with ".rollup".

    build() compacts the log and sums it up. Reports that are appended later count too: their rows are added, and the rows that
    they supersede taken off, so an answer reads those rows, the hour in which the span begins, and otherwise sums alone.
    """

    log: ReportTable

    @property
    def path(self) -> str:
        return f"{self.log.path}.rollup"

    def build(self) -> None:
        self.log.compact()
        rows = self.log.all()
        by_hour(rows).write.mode("overwrite").parquet(f"{self.path}/hours")
        words_by_hour(rows).write.mode("overwrite").parquet(f"{self.path}/words")
        rows.agg(F.coalesce(F.max("written"), F.lit(0)).alias("upto")).write.mode("overwrite").parquet(f"{self.path}/upto")

    def _parts(self, since: Column) -> tuple[Column, list[tuple[DataFrame, int]]]:
        """The first whole hour, and reports that the sums from it on lack (1) or have too many (-1)."""
        spark = self.log.spark
        whole = F.date_trunc("hour", since + F.expr("interval 59 minutes 59.999999 seconds"))
        upto = spark.read.schema("upto long").parquet(f"{self.path}/upto").first()[0]
        rows = self.log.all()
        old, new = rows.where(F.col("written") <= upto), rows.where(F.col("written") > upto)
        head = old.where((F.col("timestamp") >= since) & (F.col("timestamp") < whole) & (F.col("day") >= F.to_date(since)) & (F.col("day") <= F.to_date(whole)))
        parts = [(head, 1)]
        if new.limit(1).count():
            late = lambda df: df.where(F.col("timestamp") >= since)
            pieces = self.log.pieces()
            dealt = lambda df: df.repartition(pieces, "message_id")
            parts += [(late(current(new, pieces)), 1), (late(dealt(old).join(dealt(new.select("message_id")).distinct(), "message_id", "left_semi")), -1)]
        return whole, parts

    def stats(self, since: Column) -> DataFrame:
        """As reports.stats(), over the reports from a time on."""
        whole, parts = self._parts(since)
        sums = self.log.spark.read.schema(_HOUR).parquet(f"{self.path}/hours").where(F.col("hour") >= whole)
        for rows, sign in parts:
            sums = sums.unionByName(by_hour(rows).select("hour", *((F.col(c) * sign).alias(c) for c in _SUMS)))
        total = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS))
        mean = lambda x, n: F.coalesce(F.round(F.try_divide(F.col(x), F.col(n)), 2), F.lit(0.0))
        return total.select(F.col("messages").alias("total_messages"), F.col("detections").alias("total_detections"), "blocked", "flagged", mean("highest", "messages").alias("average_highest"), mean("milliseconds", "timed").alias("average_processing_time_ms"))

    def top_words(self, since: Column, limit: int = 10) -> DataFrame:
        """The most detected words and their counts; equal counts by the word."""
        whole, parts = self._parts(since)
        counts = self.log.spark.read.schema(_WORD).parquet(f"{self.path}/words").where(F.col("hour") >= whole).select("word", "n")
        for rows, sign in parts:
            counts = counts.unionByName(words_by_hour(rows).select("word", (F.col("n") * sign).alias("n")))
        return counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "word").limit(limit)
