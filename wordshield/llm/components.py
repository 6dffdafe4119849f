"""Connected components of a table of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: A key with over one in so many rows is looked up in a broadcast table, of fewer rows than this.
HOT = 1000


def looked_up(rows: DataFrame, key: str, table: DataFrame, of: str, few: int = 20_000) -> DataFrame:
    """The inner join of rows and table (one row for each value of `of`) on key; rows of a hot key stay where they are.

    At most `few` rows fit a task whatever their keys.
    """
    total = rows.count()
    if total <= few:
        return rows.join(table, F.col(key) == F.col(of))
    heavy = rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT > total).select("_hot")
    if not heavy.limit(1).count():
        return rows.join(table, F.col(key) == F.col(of))
    heavy = written(heavy, "heavy")
    apart = [rows.join(F.broadcast(heavy), F.col(key) == F.col("_hot"), kind) for kind in ("left_semi", "left_anti")]
    hot = table.join(F.broadcast(heavy), F.col(of) == F.col("_hot"), "left_semi")
    return apart[0].join(F.broadcast(hot), F.col(key) == F.col(of)).unionByName(apart[1].join(table, F.col(key) == F.col(of)))


def connected_components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node that it is connected with.

    Each round takes the smallest label among the neighbours, then the label of that label, so chains halve; a round
    that changes nothing ends it. Links stay in tables of the shared folder; only a count comes to the driver.
    most_rounds ends it earlier: nodes of one label are then still connected, but connected nodes may have several.
    """
    pairs = links.select("a", "b").where("a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    rounds = 0
    while True:
        near = looked_up(both, "b", labels, "node").groupBy("a").agg(F.min("label").alias("least"))
        step = written(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label")), "step")
        up = step.select(F.col("node").alias("via"), F.col("label").alias("top"))  # every label is a node
        jumped = written(looked_up(step, "label", up, "via").select("node", "old", F.col("top").alias("label")), "labels")
        rounds += 1
        done = rounds == most_rounds or not jumped.where("label <> old").limit(1).count()
        drop_written(labels)
        drop_written(step)
        labels = jumped.select("node", "label")
        if done:
            drop_written(both)
            return labels


def refined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) of connected_components(), maybe of fewer links or cut short, brought up to all links (a, b).

    Links become links between labels; usually few are left, and only those take rounds.
    """
    ends = written(labels.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("node").agg(F.min("label").alias("label")), "ends")
    of = lambda x: ends.select(F.col("node").alias(f"node_{x}"), F.col("label").alias(f"label_{x}"))
    between = looked_up(looked_up(links.select("a", "b"), "a", of("a"), "node_a"), "b", of("b"), "node_b")
    between = written(between.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b").distinct(), "between")
    if not between.limit(1).count():
        return ends
    tops = connected_components(between).select("node", F.col("label").alias("top"))
    tops = ends.select("label").distinct().join(tops, F.col("label") == F.col("node"), "left").select(F.col("label").alias("of"), F.coalesce("top", "label").alias("top"))
    return looked_up(ends, "label", tops, "of").select("node", F.col("top").alias("label"))
