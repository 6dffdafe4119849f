"""Shared pieces of the training-data operators: input columns, text keys and written intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a temporary one takes its place in local mode; on a cluster that is an error, as executors don't share their disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and a lost executor costs no rework above it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that written() made and that no later plan reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        while "=" in path.getName():
            path = path.getParent()
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_keys(text: Column) -> dict[str, Column]:
    """A text's 128-bit key as two 64-bit hashes of different seeds: equal texts, and in practice only those, share it."""
    return {"t0": F.xxhash64(text), "t1": F.xxhash64(F.lit(20_011), text)}


def inputs(df: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Only the two columns that an operator needs, as ``id`` and ``text`` (null: empty), so that no other column's name can clash.

    carry: also all columns as the struct ``row``.
    """
    row = [F.struct("*").alias("row")] if carry else []
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)


def small(df: DataFrame, limit_bytes: int, overhead: int, *texts: Column) -> bool:
    """Whether df's rows take at most limit_bytes, by the measured bytes of their texts and `overhead` a row."""
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)).cast("long") for t in texts), F.lit(overhead).cast("long"))
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit_bytes
