"""Contiguous shards of near-equal bytes, from global prefix sums of row sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def prefix_sums(rows: DataFrame, order: list[str], size: str, rows_per_partition: int = 2_000_000) -> DataFrame:
    """rows with ``before`` (sum of size over all rows before it in the order) and ``number`` (rows before it), over the whole table.

    Rows are range-partitioned by the order, into spark.sql.shuffle.partitions or more of about rows_per_partition, and
    written; each partition's total then shifts its own running sums. Only one row a partition meets in one task. Equal
    rows may land in either order, which no result can tell. The order's columns go to the driver as samples: keep them short.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_partition))
    ranged = written(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum(size).alias("part_size"), F.count("*").alias("part_rows"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = totals.select("part", F.coalesce(F.sum("part_size").over(so_far), F.lit(0)).alias("size_base"), F.coalesce(F.sum("part_rows").over(so_far), F.lit(0)).alias("rows_base"))
    within = Window.partitionBy("part").orderBy(*order)
    running = ranged.withColumns({"number": F.row_number().over(within) - 1, "before": F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)})
    joined = running.join(F.broadcast(bases) if n <= 100_000 else bases, "part")
    return joined.withColumns({"before": F.col("before") + F.col("size_base"), "number": F.col("number").cast("long") + F.col("rows_base")}).drop("part", "size_base", "rows_base")


def byte_shards(rows: DataFrame, group: Column, size: Column, shards: int, id_col: str = "doc_id", whole_groups_up_to: float = 0.01) -> DataFrame:
    """(id, grp, size, shard, slot): rows in the order of (group, id), cut into `shards` runs at equal byte targets.

    Rows of one group are neighbours. A group of at most whole_groups_up_to of a shard's target stays in one shard (the
    one that holds its middle); a larger one is cut where the target falls, between two rows, so no group, however hot,
    makes a shard larger than its target by more than that share or one row. slot counts from 0 within a shard.
    size must be positive. An empty table gives no rows; equal rows each take a place of their own.
    """
    keyed = rows.select(F.col(id_col).alias("id"), group.alias("grp"), size.cast("long").alias("size"))
    placed = written(prefix_sums(keyed, ["grp", "id"], "size"), "placed")
    total = placed.agg(F.sum("size")).first()[0] or 1
    shard_of = lambda twice: F.least(F.lit(shards - 1), F.floor(twice.cast("decimal(38,0)") * shards / (2 * total))).cast("int")
    placed = placed.withColumn("own", shard_of(F.col("before") * 2 + F.col("size")))
    # only a group over a target can move, and a target has one such group: those few are looked up
    edges = placed.groupBy("own").agg(F.min_by("grp", "number").alias("low"), F.max_by("grp", "number").alias("high"))
    both = edges.select("own", "low").union(edges.select("own", "high"))
    cut = both.groupBy(F.col("low").alias("of")).agg(F.count_distinct("own").alias("shards")).where("shards > 1").select("of")  # fewer than shards
    groups = placed.join(F.broadcast(cut), F.col("grp").eqNullSafe(F.col("of"))).groupBy("of").agg(F.min("before").alias("group_start"), F.sum("size").alias("group_size"))
    groups = groups.where(F.col("group_size") * shards <= F.lit(float(whole_groups_up_to * total)))
    out = placed.join(F.broadcast(groups), F.col("grp").eqNullSafe(F.col("of")), "left")
    twice = F.when(F.col("of").isNull(), F.col("before") * 2 + F.col("size")).otherwise(F.col("group_start") * 2 + F.col("group_size"))
    out = out.select("id", "grp", "size", "number", shard_of(twice).alias("shard"))
    firsts = out.groupBy("shard").agg(F.min("number").alias("first"))  # at most one row a shard
    return out.join(F.broadcast(firsts), "shard").select("id", "grp", "size", "shard", (F.col("number") - F.col("first")).alias("slot"))
