"""Connected components of an edge table, by rounds of large and small stars.

A star is one exchange: edges are dealt out by node, sorted, and streamed, so a node's least neighbour comes first. Nodes of very many
edges (few, by their number) are left out of the exchange: their least neighbours are broadcast, and their edges turned where they
lie. Nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X

EDGES = "u long, v long"
#: Edges from which on a node is a large one; so many are streamed in a moment.
LARGE = 1 << 16


def _stars(edges: DataFrame, large: bool, hot: DataFrame | None) -> DataFrame:
    """edges (u, v) with v < u; ``hot`` (h): nodes of very many edges. Large: each node's greater neighbours go to its least one (itself counts); small: its lesser ones and itself do."""

    def run(batches):
        node, low, last = None, None, None
        for x in batches:
            u, v = x.column(0).to_numpy(), x.column(1).to_numpy()
            if not len(u):
                continue
            new = np.concatenate([[node is None or u[0] != node], u[1:] != u[:-1]])
            first = np.flatnonzero(new)
            least = np.minimum(v[first], u[first]) if large else v[first]
            if not new[0]:
                first, least = np.concatenate([[0], first]), np.concatenate([[low], least])
            m = np.repeat(least, np.diff(np.append(first, len(u))))
            again = np.concatenate([[(u[0], v[0]) == last], (u[1:] == u[:-1]) & (v[1:] == v[:-1])])
            node, low, last = u[-1], least[-1], (u[-1], v[-1])
            if large:
                keep = ~again & (v > u) & (v != m)
                a, b = v[keep], m[keep]
            else:
                keep = ~again & (v != m)
                a, b = np.concatenate([v[keep], u[new]]), np.concatenate([m[keep], m[new]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    parts = X.parts(edges.sparkSession)

    def dealt(own: DataFrame) -> DataFrame:
        return own.repartition(parts, "u").sortWithinPartitions("u", "v").mapInArrow(run, EDGES)

    if hot is None:
        return dealt(edges)
    marked = edges.join(F.broadcast(hot), F.col("u") == F.col("h"), "left")
    most = marked.where("h is not null")
    least = F.broadcast(most.groupBy("h").agg(F.min("v").alias("m")))
    most = most.drop("h").join(least, F.col("u") == F.col("h"))
    if large:
        turned = most.where("v > h").select(F.col("v").alias("u"), F.least("m", "h").alias("v"))
    else:
        turned = most.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("h").alias("u"), F.col("m").alias("v")))
    return dealt(marked.where("h is null").select("u", "v")).union(turned).coalesce(parts)


def _large(edges: DataFrame, rows: int, most: int) -> DataFrame | None:
    """(h): nodes of more than ``most`` edges, of which there are at most 2 * rows / most; None if there is none."""
    if rows <= most:
        return None
    hot = X.durable(edges.select(F.explode(F.array("u", "v")).alias("h")).groupBy("h").count().where(F.col("count") > most).select("h"))
    return hot if hot.limit(1).count() else None


def components(edges: DataFrame, most: int = LARGE) -> DataFrame:
    """(u, v): each node of the edges but the least of its component, and that least one. edges: two columns of numbers."""
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    now = X.durable(now)
    mark, hot = None, _large(now, now.count(), most)
    while True:
        now = X.durable(_stars(_stars(now, True, hot), False, hot))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            return now
        mark, hot = new, _large(now, new[0], most)
