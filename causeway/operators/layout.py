"""Layouts of models that keep neighbourhoods: uniform manifold approximation and projection (McInnes, Healy and Melville, 2018).

1. Profiles become sketches of at most ``SKETCH`` numbers by a seeded projection (shorter ones stay as they are).
2. A graph of nearest neighbours by neighbour descent: each model's neighbours, and some it is a neighbour of, are compared with each
   other, and each keeps the nearest it has met, round by round.
3. Distances become fuzzy weights, so that each model has the same sum of them; both directions are united.
4. From principal components on, positions follow sampled gradients. Models are dealt to shards that depend on their number alone; in a round a
   shard moves its own models for some epochs, while the positions of others, among them a seeded pool to keep away from, stand.

All draws are hashes or seeded by shard and round, and sums run in a fixed order, so a seed gives the same layout however the
work is dealt out. No table passes one task or the driver; a task holds a shard's edges and the positions that they meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.errors import ClusterError
from causeway.functions.durable import durable, number_rows

NEIGHBOURS, MIN_DIST, SPREAD = 15, 0.1, 1.0
SKETCH = 64
#: Rounds of neighbour descent at most, and the share of changed neighbours that ends them.
DESCENTS, SETTLED = 12, 0.001
#: Models of a shard, rounds, epochs of a round, models drawn to keep away from in each, and how many of these an edge meets.
SHARD, ROUNDS, EPOCHS, POOL, AWAY = 2048, 20, 10, 512, 5
_RATE = 0.25
_SALTS = 32


def sketches(profiles: DataFrame, dims: int = SKETCH, seed: int = 0) -> DataFrame:
    """(model_id, vec): profiles of up to ``dims`` numbers as they are, longer ones projected by random signs; rounded, as sums may come in any order."""

    def run(batches):
        for x in batches:
            rows = x.column(1)
            p = rows.flatten().to_numpy().reshape(len(x), -1)
            if p.shape[1] > dims:
                signs = np.random.default_rng(seed).integers(0, 2, (p.shape[1], dims)) * 2.0 - 1
                p = p @ signs / dims**0.5
            p = np.round(p, 6)
            offs = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([x.column(0), pa.ListArray.from_arrays(offs, pa.array(p.ravel()))], ["model_id", "vec"])

    return profiles.select("model_id", "profile").mapInArrow(run, "model_id string, vec array<double>")


def _least(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; a key of very many rows is cut down in shares first."""
    for salts in (_SALTS, 1):
        w = Window.partitionBy(key, F.pmod(F.xxhash64("u", "v"), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")
    return rows


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, seed: int = 0, rounds: int = DESCENTS) -> DataFrame:
    """(u, v, d): the k nearest of each of the vectors (i from 0, vec) by neighbour descent."""
    vectors = durable(vectors)
    n = vectors.count()
    k = min(k, n - 1)
    first = vectors.select(F.col("i").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"))
    first = first.select("u", F.pmod(F.col("u") + 1 + F.pmod(F.xxhash64(F.lit(seed), "u", "j"), F.lit(max(n - 1, 1))), F.lit(n)).alias("v")).distinct()
    graph = durable(first.withColumn("d", F.lit(float("inf"))))

    def met(batches):
        for x in batches:
            us, vs, ds = [], [], []
            for own, vec in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                ids, p = np.array(own, np.int64), np.array(vec)
                d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
                a, b = np.nonzero(~np.eye(len(ids), dtype=bool))
                # of what a neighbourhood shows a model only the nearest k can matter
                place = np.argsort(np.argsort(np.where(np.eye(len(ids), dtype=bool), np.inf, d), axis=1, kind="stable"), axis=1)[a, b]
                near = place < k
                us.append(ids[a[near]])
                vs.append(ids[b[near]])
                ds.append(d[a, b][near])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0)) for c in (us, vs, ds)], schema=pa.schema([("u", pa.int64()), ("v", pa.int64()), ("d", pa.float64())]))

    for turn in range(rounds):
        back = _least(graph.select("u", "v"), "v", [F.xxhash64(F.lit(seed), F.lit(turn), "u", "v"), F.col("u")], k)
        members = graph.select(F.col("u").alias("m"), "v").union(back.select(F.col("v").alias("m"), F.col("u").alias("v"))).union(vectors.select("i", "i")).distinct()
        hoods = members.join(vectors.withColumnRenamed("i", "v"), "v").groupBy("m").agg(F.array_sort(F.collect_list(F.struct("v", "vec"))).alias("own"))
        pairs = hoods.select("m", F.col("own.v").alias("ids"), F.col("own.vec").alias("vecs")).mapInArrow(met, "u long, v long, d double")
        new = graph.union(pairs).groupBy("u", "v").agg(F.min("d").alias("d"))
        new = durable(_least(new, "u", [F.col("d"), F.col("v")], k))
        changed = new.join(graph.where("d < double('inf')"), ["u", "v"], "left_anti").count()
        graph = new
        if changed <= SETTLED * n * k:
            break
    return graph


def weights(graph: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(u, v, w): fuzzy weights of both directions united, each edge both ways."""

    def run(batches):
        for x in batches:
            us, vs, ws = [], [], []
            for u, own, dist in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                d = np.array(dist)
                if not d.any():  # equal models: nothing to scale
                    us += [u] * len(own)
                    vs += own
                    ws.append(np.ones(len(d)))
                    continue
                rho = d[d > 0].min() if (d > 0).any() else 0.0
                gap = np.maximum(d - rho, 0)
                low, high, s, goal = 0.0, np.inf, 1.0, np.log2(len(d))
                for _ in range(64):
                    total = np.exp(-gap / s).sum()
                    if abs(total - goal) < 1e-5:
                        break
                    if total > goal:
                        high, s = s, (low + s) / 2
                    else:
                        low, s = s, 2 * s if high == np.inf else (s + high) / 2
                s = max(s, 1e-3 * (d.mean() or 1.0))
                us += [u] * len(own)
                vs += own
                ws.append(np.exp(-gap / s))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(np.concatenate(ws) if ws else np.zeros(0))], ["u", "v", "w"])

    nodes = graph.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("own"))  # k rows each
    one = nodes.select("u", F.col("own.v").alias("v"), F.col("own.d").alias("d")).mapInArrow(run, "u long, v long, w double")
    both = one.select("u", "v", F.col("w").alias("a"), F.lit(None).cast("double").alias("b")).union(one.select("v", "u", F.lit(None).cast("double"), "w"))
    both = both.groupBy("u", "v").agg(F.coalesce(F.max("a"), F.lit(0.0)).alias("a"), F.coalesce(F.max("b"), F.lit(0.0)).alias("b"))
    return both.select("u", "v", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))


def curve(min_dist: float = MIN_DIST, spread: float = SPREAD) -> tuple[float, float]:
    """a and b of the curve 1 / (1 + a x^(2b)) nearest to 1 up to ``min_dist`` and an exponential from there on, by Gauss-Newton steps."""
    x = np.linspace(0, 3 * spread, 301)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(200):
        xb = x ** (2 * p[1])
        f = 1 / (1 + p[0] * xb)
        jac = np.stack([-xb * f**2, -2 * p[0] * xb * np.log(x) * f**2], axis=1)
        step = np.linalg.lstsq(jac, y - f, rcond=None)[0]
        p = np.maximum(p + 0.5 * step, 1e-3)
    return float(p[0]), float(p[1])


def place(edges: DataFrame, start: DataFrame, dims: int = 2, seed: int = 0, rounds: int = ROUNDS, epochs: int = EPOCHS, min_dist: float = MIN_DIST, spread: float = SPREAD) -> DataFrame:
    """(i, at): positions after sampled gradients from ``start`` (i, at) along ``edges`` (u, v, w)."""
    a, b = curve(min_dist, spread)
    start = durable(start)
    n = start.count()
    shards = -(-n // SHARD)
    edges = durable(edges.withColumn("shard", F.floor(F.col("u") / SHARD)))  # neighbours in number share a shard
    most = edges.agg(F.max("w")).first()[0] or 1.0
    meets = durable(edges.select(F.col("shard").alias("s"), F.col("v").alias("i")).union(edges.select("shard", "u")).distinct())

    def summed(p: np.ndarray, steps: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(p, steps[:, j], n) for j in range(dims)], axis=1)

    def moved(turn: int):
        def run(own: pa.Table, known: pa.Table) -> pa.Table:
            own, known = own.sort_by([("u", "ascending"), ("v", "ascending")]), known.sort_by([("i", "ascending"), ("drawn", "ascending")])
            if not len(own):
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))], ["i", "at"])
            ids, drawn = known.column("i").to_numpy(), known.column("drawn").to_numpy()
            at = known.column("at").combine_chunks().flatten().to_numpy().reshape(-1, dims)
            pool = at[drawn]
            ids, at = ids[~drawn], at[~drawn].copy()
            u, v = (np.searchsorted(ids, own.column(c).to_numpy()) for c in "uv")
            share, shard = own.column("w").to_numpy() / most, int(own.column("shard")[0].as_py())
            draw = np.random.default_rng([seed, shard, turn])
            inside = np.unique(u)
            for e in range(epochs):
                rate = _RATE * (1 - (turn * epochs + e) / (rounds * epochs))
                use = draw.random(len(u)) < share
                p, q = u[use], v[use]
                gap = at[p] - at[q]
                d2 = (gap**2).sum(axis=1)
                power = d2**b
                with np.errstate(divide="ignore", invalid="ignore"):
                    pull = np.where(d2 > 0, -2 * a * b * power / d2 / (1 + a * power), 0.0)
                step = summed(p, np.clip(pull[:, None] * gap, -4, 4), len(at))
                p = np.repeat(p, AWAY)
                gap = at[p] - pool[draw.integers(0, len(pool), len(p))]
                d2 = (gap**2).sum(axis=1)
                push = 2 * b / ((0.001 + d2) * (1 + a * d2**b))
                step += summed(p, np.where((d2 > 0)[:, None], np.clip(push[:, None] * gap, -4, 4), 0.0), len(at))
                at[inside] += rate * np.clip(step[inside], -8, 8)
            flat = pa.array(np.round(at[inside], 9).ravel())
            return pa.table([pa.array(ids[inside]), pa.ListArray.from_arrays(pa.array(np.arange(len(inside) + 1) * dims, pa.int32()), flat)], ["i", "at"])

        return run

    now = start
    every = edges.sparkSession.range(shards).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(POOL - 1))).alias("j"))
    for turn in range(rounds):
        drawn = every.select("s", F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "s", "j"), F.lit(n)).alias("i")).distinct()
        asked = meets.withColumn("drawn", F.lit(False)).union(drawn.withColumn("drawn", F.lit(True)))
        known = asked.join(now, "i").select("s", "i", "drawn", "at")
        now = durable(edges.groupBy("shard").cogroup(known.groupBy("s")).applyInArrow(moved(turn), "i long, at array<double>"))
    return now


def umap(profiles: DataFrame, dims: int = 2, k: int = NEIGHBOURS, seed: int = 42, min_dist: float = MIN_DIST, spread: float = SPREAD) -> DataFrame:
    """(model_id, x, y[, z]) of profiles (model_id, profile), which all have equally many numbers. Fewer than three models lie on a line."""
    from causeway.operators.clusters import embed

    if k < 2:
        raise ClusterError("at least two neighbours are needed", "INVALID_NEIGHBOURS")
    profiles = durable(profiles)
    number = durable(number_rows(profiles.select("model_id"), "model_id", name="i").withColumn("i", (F.col("i") - 1).cast("long")))
    vectors = sketches(profiles, SKETCH, seed).join(number, "model_id").select("i", "vec")
    return lay_out(number, embed(profiles, dims), lambda: neighbours(vectors, k, seed), dims, k, seed, min_dist, spread)


def lay_out(number: DataFrame, start: DataFrame, graph: Callable[[], DataFrame], dims: int = 2, k: int = NEIGHBOURS, seed: int = 42, min_dist: float = MIN_DIST, spread: float = SPREAD) -> DataFrame:
    """``umap`` from the models' numbers (model_id, i), their first places (model_id, x, y[, z]) and what gives their nearest ones (u, v, d)."""
    if k < 2:
        raise ClusterError("at least two neighbours are needed", "INVALID_NEIGHBOURS")
    names = ["x", "y", "z"][:dims]
    start = durable(start)
    if number.count() < 3:
        return start
    size = F.greatest(*(F.max(F.abs(F.col(c))) for c in names))
    size = start.agg(size).first()[0] or 1.0
    noise = lambda j: F.pmod(F.xxhash64(F.lit(seed), "i", F.lit(j)), F.lit(1 << 20)) / float(1 << 20) * 1e-2
    start = start.join(number, "model_id").select("i", F.array(*(F.round(F.col(c) / size * 10, 6) + noise(j) for j, c in enumerate(names))).alias("at"))
    edges = weights(graph())
    at = place(edges, start, dims, seed, min_dist=min_dist, spread=spread)
    return at.join(number, "i").select("model_id", *(F.get("at", F.lit(j)).alias(c) for j, c in enumerate(names)))
