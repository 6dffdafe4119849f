"""A self check of the scanner."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.lexicon import Lexicon
from .scan import scan


def self_check(spark: SparkSession, lexicon: Lexicon) -> dict[str, object]:
    """Scan one harmless message with the list; reports the number of words and whether a report came back."""
    message = spark.createDataFrame([("health", "test")], "message_id string, text string")
    report = scan(message, lexicon, keep=False).reports.first()
    return {"status": "ok" if report is not None else "failed", "words": lexicon.count(), "detections": report["summary"]["total_detections"] if report else None}
