"""Delivery of reports to a receiver, with a record of every attempt."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config

_ATTEMPT = "message_id string, sent boolean, error string"


def webhook(url: str, timeout: float = 5.0) -> Callable[[str, int], None]:
    """A sender that posts a report as JSON; any answer but success is an error."""

    def send(report: str, attempt: int) -> None:
        request = urllib.request.Request(url, report.encode(), {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=timeout).close()

    return send


@dataclass
class Outbox:
    """Attempts to send reports, kept at path: a folder for each round.

    send(report, attempt) runs in the tasks and raises where it fails. A report whose attempt succeeded is not sent again; one that
    failed is tried in the next round, `most` times in all. A task that is lost before its round is recorded sends its reports again,
    so a receiver should know them by message id.
    """

    spark: SparkSession
    path: str
    send: Callable[[str, int], None]
    most: int = 3

    @staticmethod
    def configured(spark: SparkSession, config: Config, path: str = "./data/outbox") -> Outbox | None:
        """An outbox to the configuration's webhook_url; None without one."""
        url = config.reporting.webhook_url
        return Outbox(spark, path, webhook(url)) if url else None

    def attempts(self) -> DataFrame:
        """(message_id, sent, error, round) of every attempt so far."""
        try:
            return self.spark.read.schema(f"{_ATTEMPT}, round int").parquet(self.path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], f"{_ATTEMPT}, round int")

    def _pending(self, reports: DataFrame) -> DataFrame:
        """Reports neither sent nor given up, with the number of their next attempt."""
        known = self.attempts().groupBy("message_id").agg(F.bool_or("sent").alias("sent"), F.count("*").cast("int").alias("tries"))
        open_ = reports.join(known.where(F.col("sent") | (F.col("tries") >= self.most)), "message_id", "left_anti")
        tried = open_.join(known.select("message_id", "tries"), "message_id", "left")
        return tried.select("message_id", (F.coalesce("tries", F.lit(0)) + 1).alias("attempt"), F.to_json(F.struct(*reports.columns)).alias("report"))

    def deliver(self, reports: DataFrame) -> DataFrame:
        """Send reports (message_id, ..., one a message id) in rounds, until all are sent or given up; returns status()."""
        send = self.send

        def attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sent, errors = [], []
                for report, number in zip(batch.column("report").to_pylist(), batch.column("attempt").to_pylist()):
                    try:
                        send(report, number)
                        errors.append(None)
                    except Exception as failed:
                        errors.append(f"{type(failed).__name__}: {failed}"[:500])
                    sent.append(errors[-1] is None)
                yield pa.RecordBatch.from_arrays([batch.column("message_id"), pa.array(sent, pa.bool_()), pa.array(errors, pa.string())], ["message_id", "sent", "error"])

        first = self.attempts().agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]
        for number in range(first + 1, first + self.most + 1):
            pending = self._pending(reports)
            if not pending.limit(1).count():
                break
            pending.mapInArrow(attempt, _ATTEMPT).write.parquet(f"{self.path}/round={number}")
        return self.status()

    def status(self) -> DataFrame:
        """(message_id, sent, tries, error): error is that of the last attempt, if none succeeded."""
        last = F.when(~F.bool_or("sent"), F.max_by("error", "round"))
        return self.attempts().groupBy("message_id").agg(F.bool_or("sent").alias("sent"), F.count("*").alias("tries"), last.alias("error"))

    def hook(self) -> Callable[[DataFrame], None]:
        """For ReportTable: delivers what an append has stored."""
        return lambda reports: self.deliver(reports) and None
