"""Rows stored in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in spark.checkpoint.dir; a folder of our own only where that is unset on one machine, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or "file:///tmp/checkpoints")
    return df.checkpoint()


def number_rows(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """``df`` with each row's place (from 1) in this order, which must be a strict one. No partition holds more than its share: places are counted within ranges of the order."""
    ranged = durable(df.orderBy(*order)).withColumn("_part", F.spark_partition_id())
    before, total = [], 0
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():  # a row a partition
        before.append((r["_part"], total))
        total += r["count"]
    base = df.sparkSession.createDataFrame(before, "_part int, _base long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + place).drop("_part", "_base")


def front_coded(spark: SparkSession) -> None:
    """Has this session's later Parquet files keep of a string only where it differs from the one before (pages of version 2), unless a version was chosen.

    A table's rows carry no options for whoever writes them, so this is a setting of the session. Spark, DuckDB and Arrow read both versions.
    """
    if spark.conf.get("parquet.writer.version", None) is None:
        spark.conf.set("parquet.writer.version", "v2")
