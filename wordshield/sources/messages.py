"""Message sources and response rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGE


#: What a message may bring besides its id and text, and its type in files that don't say.
CARRIED = {"options": "struct<fuzzy: boolean, leetspeak: boolean, homoglyph: boolean, separator_bypass: boolean, repetition: boolean, max_distance: int>", "context": "map<string, string>", "timestamp": "timestamp"}


def read_messages(spark: SparkSession, path: str, form: str = "parquet", id_col: str = "message_id", text_col: str = "text", carried: tuple[str, ...] | None = None, **options: str) -> DataFrame:
    """(message_id, text[, options, context, timestamp]) from files of any format that Spark reads.

    carried names the other columns to keep; None keeps those that the files' own schema has. JSON files have none, so what
    is to be kept of them must be named; CSV files can hold a timestamp, of those.
    """
    reader = spark.read.format(form).options(**options)
    if form in ("json", "csv"):
        carried = carried or ()
        fields = ", ".join([f"`{c}` string" for c in (id_col, text_col)] + [f"`{c}` {CARRIED[c]}" for c in carried])
        reader = reader.schema(fields) if form == "json" else reader.option("header", True)
    rows = reader.load(path)
    more = [F.col(c) if form != "csv" else F.col(c).cast(CARRIED[c]) for c in (CARRIED if carried is None else carried) if c in rows.columns and c not in (id_col, text_col)]
    return rows.select(F.col(id_col).cast(MESSAGE["message_id"].dataType).alias("message_id"), F.col(text_col).cast("string").alias("text"), *more)


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    """(message_id, text): the first column of a CSV file with a header, without its empty cells; ids are the texts' hashes."""
    rows = spark.read.csv(path, header=True)
    text = F.col(f"`{rows.columns[0]}`")
    return rows.where(text.isNotNull()).select(F.sha1(text).alias("message_id"), text.alias("text"))


def checked(messages: DataFrame, most_characters: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Messages of 1 to most_characters characters, and the others with an ``error``; one bad message stops no batch."""
    length = F.coalesce(F.length("text"), F.lit(0))
    good = (length >= 1) & (length <= most_characters)
    error = F.when(length == 0, F.lit("empty text")).otherwise(F.lit(f"over {most_characters} characters"))
    return messages.where(good), messages.where(~good).select("message_id", error.alias("error"))


def responses(reports: DataFrame) -> DataFrame:
    """(message_id, response): each report as one JSON document."""
    return reports.select("message_id", F.to_json(F.struct("*")).alias("response"))
