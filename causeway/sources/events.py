"""Hypotheses from the driver's event table.

A user is a model and an event type a node, present if the user has such an event (before a day, if one is named), timed by the day of the first one. For each two
types there is an edge from the alphabetically first: causal if it comes first, non-causal if later, unknown on one day.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import models as M
from causeway.sources import registry as R

#: The day that ends the slice of the first build plan.
SLICE = "2024-01-04 00:00:00"


def nodes(spark: SparkSession, sf_dir: str, types: list[str] | None = None, before: str | None = None) -> DataFrame:
    """(model_id, node, timing)"""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    if before:
        ev = ev.where(F.col("ts") < F.lit(datetime.fromisoformat(before)).cast("timestamp_ntz"))
    if types:
        ev = ev.where(F.col("event_type").isin(types))
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return ev.groupBy(F.col("user_id").cast("string").alias("model_id"), F.col("event_type").alias("node")).agg(F.min(day).cast("int").alias("timing"))


def registry(spark: SparkSession, sf_dir: str, types: list[str] | None = None, **focal) -> R.Registry:
    names = types or sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().collect())
    allowed = [{"source": a, "target": b, "direction": "->", "rule": "allow"} for i, a in enumerate(names) for b in names[i + 1 :]]
    return R.build([{"name": n} for n in names], constraints=allowed, **focal)


def claims(spark: SparkSession, sf_dir: str, reg: R.Registry, before: str | None = None) -> DataFrame:
    n = nodes(spark, sf_dir, [r["source"] for r in reg.nodes], before)
    ids = spark.createDataFrame([(r["source"], r["comp_id"]) for r in reg.nodes], "node string, comp_id string")
    ends = spark.createDataFrame([(r["source"], r["target"], r["comp_id"]) for r in reg.edges], "s string, t string, comp_id string")
    a, b = n.toDF("model_id", "s", "ts"), n.toDF("model_id", "t", "tt")
    status = F.when(F.col("ts") < F.col("tt"), "causal").when(F.col("ts") > F.col("tt"), "non-causal").otherwise("unknown")
    edges = a.join(b, "model_id").join(F.broadcast(ends), ["s", "t"]).select("model_id", "comp_id", status.alias("status"), F.lit(None).cast("int").alias("timing"))
    return n.join(F.broadcast(ids), "node").select("model_id", "comp_id", F.lit("present").alias("status"), "timing").union(edges)


def packed(spark: SparkSession, sf_dir: str, before: str | None = None) -> tuple[R.Registry, DataFrame]:
    reg = registry(spark, sf_dir)
    return reg, M.pack(claims(spark, sf_dir, reg, before), reg).persist()  # one row a model, used more than once
