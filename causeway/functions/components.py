"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.durable import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node of ``edges`` (u, v) the least node that it is joined with.

    Each round hangs the neighbours of a node that are larger than it on the least of them, then those that are smaller. The
    least neighbour is a sum that tasks make before they meet, and a node's edges are joined with it, so no task holds the
    edges of a node. Depths shrink to a fraction each round; the rounds end when all hang on a root.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        new = durable(down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        if not new.join(now, ["u", "v"], "left_anti").limit(1).count() and not now.join(new, ["u", "v"], "left_anti").limit(1).count():
            break
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
