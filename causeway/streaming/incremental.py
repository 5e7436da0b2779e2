"""Upkeep of a pair table as models change (an extension: the reference recomputes).

Each batch of changed models replaces just the pairs that touch them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from causeway.operators import dyads as D
from causeway.operators import models as M
from causeway.sources.registry import Registry


def refresh(dyads: DataFrame, models: DataFrame, registry: Registry, changed: DataFrame) -> DataFrame:
    """``dyads`` (see dyads.all_pairs) brought up to ``models``: pairs of changed models are compared anew, those of models that are gone fall away."""
    here = models.select("model_id").distinct()
    ids = changed.select("model_id").distinct()
    kept = dyads.join(ids.withColumnRenamed("model_id", "ego_id"), "ego_id", "left_anti").join(ids.withColumnRenamed("model_id", "alter_id"), "alter_id", "left_anti")
    kept = kept.join(here.withColumnRenamed("model_id", "ego_id"), "ego_id", "left_semi").join(here.withColumnRenamed("model_id", "alter_id"), "alter_id", "left_semi")
    return kept.select(*dyads.columns).unionByName(D.touching(models, registry, ids.join(here, "model_id", "left_semi")))


def upkeep(claims: DataFrame, registry: Registry, state: str, version: Callable[[int], str] = "v{:08d}".format):
    """A ``foreachBatch`` writer of a claims stream: whole new claims of models go to ``state``/claims, the refreshed pairs to ``state``/dyads.

    A batch writes a new version by its number, from the one before: one that runs again writes the same rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("model_id", "comp_id", "status", "timing")
        if number:
            old = spark.read.parquet(f"{state}/claims/{version(number - 1)}")
            new = old.join(new.select("model_id").distinct(), "model_id", "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{state}/claims/{version(number)}")
        models = M.pack(spark.read.parquet(f"{state}/claims/{version(number)}"), registry)
        if number:
            pairs = refresh(spark.read.parquet(f"{state}/dyads/{version(number - 1)}"), models, registry, batch.select("model_id"))
        else:
            pairs = D.all_pairs(models, registry)
        pairs.write.mode("overwrite").parquet(f"{state}/dyads/{version(number)}")

    return claims.writeStream.foreachBatch(run).option("checkpointLocation", f"{state}/checkpoint")


def latest(spark, state: str) -> DataFrame:
    """The newest version of the pairs."""
    return spark.read.parquet(_newest(spark, f"{state}/dyads"))


def _newest(spark, folder: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return max(str(x.getPath()) for x in found)
