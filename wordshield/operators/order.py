"""Numbering rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(rows: DataFrame, range_: Column, order: list[str], counts: dict[str, Column]) -> DataFrame:
    """rows with a column for each of counts: how many rows up to this one, by `order`, meet the condition.

    range_ is a long that rises with the order and cuts the rows into pieces of bounded size. Each piece counts for itself; only
    the pieces' totals, a row each, are added up in one place.
    """
    rows = rows.withColumn("_range", range_)
    totals = rows.groupBy("_range").agg(*(F.count_if(c).alias(f"_all_{k}") for k, c in counts.items()))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *(F.coalesce(F.sum(f"_all_{k}").over(upto), F.lit(0)).alias(f"_before_{k}") for k in counts))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(before), "_range")
    out = out.withColumns({k: F.count_if(c).over(within) + F.col(f"_before_{k}") for k, c in counts.items()})
    return out.drop("_range", *(f"_before_{k}" for k in counts))


def line_numbers(rows: DataFrame, name: str) -> DataFrame:
    """rows as they lie in their files, with their numbers from 1 on: a piece is a partition."""
    placed = rows.withColumn("_line", F.monotonically_increasing_id())
    return counted(placed, F.shiftright("_line", 33), ["_line"], {name: F.lit(True)}).drop("_line")
