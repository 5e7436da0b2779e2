"""Means over pairs of models by classes: models that claim alike have the same counts with any other, so a pair of classes stands for all pairs of their models.

Classes are at most as many as models, and few where registries are small: of five event types at most 1,082, however many users there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.errors import ClusterError
from causeway.functions.durable import durable, number_rows
from causeway.operators import clusters as C
from causeway.operators import dyads as D
from causeway.operators import layout as L
from causeway.sources.registry import Registry


#: Shares of the classes that look for their neighbours among all classes.
_SHARES = 32


def claims(registry: Registry) -> list[str]:
    """The columns that all counts of a pair come from."""
    return [f"{k}{i}" for k in ("np", "app", "cm", "xm") for i in range(registry.words)]


def classes(models: DataFrame, registry: Registry, *by: str) -> DataFrame:
    """(claims, ``by``, n): how many models claim so."""
    return durable(models.groupBy(*claims(registry), *by).agg(F.count("*").alias("n")))


def pairs(of: DataFrame, registry: Registry, *by: str) -> DataFrame:
    """Pairs of classes (claims, ``by``, n) with columns e_ and a_, their similarity, and how many of the second a model of the first meets (itself aside)."""
    own = claims(registry)
    named = of.withColumn("model_id", F.concat_ws(",", *own, *by))
    out = D.pairs(named, registry, itself=True)
    c = D.counters(registry)
    return out.withColumns({"score": D.similarity(c["shared"].cast("bigint"), c["union_claims"].cast("bigint")), "others": F.col("a_n") - (F.col("e_model_id") == F.col("a_model_id")).cast("long")})


def of_models(models: DataFrame, registry: Registry) -> DataFrame:
    """(model_id, pairs, mean_score): as ``summaries.of_models`` of all pairs. Both orders of a pair score alike."""
    own = claims(registry)
    p = pairs(classes(models, registry), registry)
    total = p.groupBy(*(F.col(f"e_{c}").alias(c) for c in own)).agg(F.sum(F.col("score") * F.col("others")).alias("total"), F.sum("others").alias("k"))
    found = total.where("k > 0").select(*own, (2 * F.col("k")).alias("pairs"), (F.col("total") / F.col("k")).alias("mean_score"))
    return models.select("model_id", *own).join(found, own).select("model_id", "pairs", "mean_score")


def centralities(models: DataFrame, registry: Registry, assignments: DataFrame) -> DataFrame:
    """(cluster_id, model_id, total, pairs): as ``clusters.centralities`` of all pairs."""
    own = claims(registry)
    placed = assignments.where("cluster_id is not null").join(models.select("model_id", *own), "model_id").select("cluster_id", "model_id", *own)
    p = pairs(classes(placed, registry, "cluster_id"), registry, "cluster_id").where("e_cluster_id = a_cluster_id")
    total = p.groupBy(*(F.col(f"e_{c}").alias(c) for c in ("cluster_id", *own))).agg((2 * F.sum(F.col("score") * F.col("others"))).alias("total"), (2 * F.sum("others")).alias("pairs"))
    return placed.join(total, ["cluster_id", *own]).select("cluster_id", "model_id", "total", "pairs")


def summaries(models: DataFrame, registry: Registry, assignments: DataFrame) -> DataFrame:
    """As ``clusters.summaries`` of all pairs."""
    return C.of_clusters(centralities(models, registry, assignments))


def representatives(models: DataFrame, registry: Registry, assignments: DataFrame, top: int = 3) -> DataFrame:
    """As ``clusters.representatives`` of all pairs."""
    return C.most_central(centralities(models, registry, assignments), top)


def contrast(models: DataFrame, registry: Registry, assignments: DataFrame, prior: str, internal: float = 0.6, far: float = 0.4) -> DataFrame:
    """As ``clusters.contrast`` of all pairs: only the prior model is compared with each other one."""
    c = D.counters(registry)
    near = D.pairs(models.where(F.col("model_id") == prior), registry, models).select(F.col("a_model_id").alias("model_id"), D.similarity(c["shared"].cast("bigint"), c["union_claims"].cast("bigint")).alias("score"))
    return C.contrasted(durable(centralities(models, registry, assignments)), near, assignments, internal, far)


def _profiles(p: DataFrame) -> DataFrame:
    """(model_id, profile, n): a class's similarity with each class, in the order of their names."""
    row = F.struct(F.col("a_model_id").alias("id"), F.col("score").cast("double").alias("score"))
    return p.groupBy(F.col("e_model_id").alias("model_id"), F.col("e_n").alias("n")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["score"]).alias("profile"))


def _named(models: DataFrame, registry: Registry) -> DataFrame:
    return models.select("model_id", F.concat_ws(",", *claims(registry)).alias("class"))


def embed(models: DataFrame, registry: Registry, dims: int = 2) -> DataFrame:
    """(model_id, x, y[, z]): as ``clusters.embed`` of all aligned profiles. Models of a class have the same profile, so classes count as often as they have models."""
    at = C.embed(_profiles(pairs(classes(models, registry), registry)), dims, weight="n")
    return _named(models, registry).join(at.withColumnRenamed("model_id", "class"), "class").drop("class")


def _signs(number: DataFrame, dims: int, seed: int) -> DataFrame:
    """(class, g): sums over the models (class, i) of the random signs that ``layout.sketches`` gives to place i; each row's are drawn by skipping those before."""

    def run(batches):
        source = np.random.PCG64(seed)
        first, total = source.state, {}
        for x in batches:
            for name, i in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                source.state = first
                source.advance(i * dims // 2)  # a draw takes half a word
                signs = np.random.Generator(source).integers(0, 2, dims) * 2 - 1
                total[name] = total[name] + signs if name in total else signs
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["class", "g"])

    parts = number.select("class", "i").mapInArrow(run, "class string, g array<long>")
    return parts.groupBy("class").agg(F.array(*(F.sum(F.get("g", F.lit(d))) for d in range(dims))).alias("g"))


def sketches(p: DataFrame, number: DataFrame, dims: int = L.SKETCH, seed: int = 0) -> DataFrame:
    """(class, vec): as ``layout.sketches`` of all profiles of more than ``dims`` numbers. ``p``: pairs of classes; ``number``: (class, i) of all models."""
    if dims % 2:
        raise ClusterError("sketches have an even number of places", "INVALID_SKETCH")
    g = _signs(number, dims, seed).withColumnRenamed("class", "a_model_id")
    sums = [F.bround(F.sum(F.col("score") * F.get("g", F.lit(d))) / dims**0.5, 6) for d in range(dims)]
    return p.join(g, "a_model_id").groupBy(F.col("e_model_id").alias("class")).agg(F.array(*sums).alias("vec"))


def neighbours(number: DataFrame, vectors: DataFrame, k: int = L.NEIGHBOURS, seed: int = 0) -> DataFrame:
    """(u, v, d): the k nearest of each model, exactly, from the models (i from 0, class) and the classes' sketches (class, vec).

    Models of a class lie at one point, so classes alone are compared: a model takes its own class first, then the next nearest ones up to k models. Of a
    class that has more than are wanted it takes those in seeded places after its own, so that no model is everyone's neighbour.
    """
    size = number.groupBy("class").agg(F.count("*").alias("n"))
    within = F.row_number().over(Window.partitionBy("class", "part").orderBy("i"))
    part = number.withColumn("part", F.floor(F.col("i") / L.SHARD))
    before = Window.partitionBy("class").orderBy("part")  # rows of a class and part
    base = part.groupBy("class", "part").agg(F.count("*").alias("own")).select("class", "part", (F.sum("own").over(before) - F.col("own")).alias("base"))
    ranked = durable(part.withColumn("r", within).join(base, ["class", "part"]).select("i", "class", (F.col("r") + F.col("base") - 1).alias("r")))
    of = durable(vectors.join(size, "class"))

    def nearest(own, every) -> pa.Table:
        """Of each class (class, vec, n): which classes its models take neighbours from, how many, and how far they are."""
        every = every.sort_by("class")
        names, n, p = every.column("class").to_pylist(), every.column("n").to_numpy(), _matrix(every)
        out = []
        for name, vec in [] if not len(own) else zip(own.column("class").to_pylist(), _matrix(own), strict=True):
            d = np.sqrt(((p - vec) ** 2).sum(axis=1))
            at = names.index(name)
            d[at], left = -1, k
            for j in np.argsort(d, kind="stable")[: k + 1].tolist():
                take = min(left, int(n[j]) - (j == at))
                if take > 0:
                    out.append((name, names[j], take, max(float(d[j]), 0.0), j == at))
                left -= take
                if not left:
                    break
        return pa.Table.from_pylist([dict(zip(("class", "other", "take", "d", "same"), r, strict=True)) for r in out], schema=pa.schema([("class", pa.string()), ("other", pa.string()), ("take", pa.int32()), ("d", pa.float64()), ("same", pa.bool_())]))

    dealt = of.withColumn("s", F.pmod(F.xxhash64("class"), F.lit(_SHARES)).cast("int"))
    every = of.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))  # classes are few: each share meets them all
    taken = dealt.groupBy("s").cogroup(every.groupBy("s")).applyInArrow(nearest, "class string, other string, take int, d double, same boolean")
    taken = taken.join(size.withColumnRenamed("class", "other"), "other")
    # steps from a model's place in its class to places in the other one; in a large class they stay near, so that few shards meet
    span = F.least(F.col("n") - F.col("same").cast("int"), F.lit(L.SHARD // 2))
    step = F.slice(F.array_sort(F.transform(F.sequence(F.lit(1), span.cast("int")), lambda j: F.struct(F.xxhash64(F.lit(seed), "other", j).alias("h"), j.alias("j")))), 1, F.col("take"))
    steps = durable(taken.select("class", "other", "n", "d", "same", F.explode(F.when(F.col("take") == span, F.transform(F.sequence(F.lit(1), F.col("take")), lambda j: F.struct(F.lit(0).cast("long").alias("h"), j.alias("j")))).otherwise(step)).alias("x")).select("class", "other", "n", "d", "same", F.col("x.j").alias("j")))
    sizes = size.withColumnsRenamed({"n": "from"})
    first = F.when(F.col("same"), F.col("r")).otherwise(F.floor(F.col("r") * F.col("n") / F.col("from")))  # the same share of the way through the other class
    asked = ranked.join(sizes, "class").join(F.broadcast(steps), "class").select(F.col("i").alias("u"), "other", F.pmod(first + F.col("j"), F.col("n")).alias("r"), "d")
    to = ranked.select(F.col("i").alias("v"), F.col("class").alias("other"), "r")
    return asked.join(to, ["other", "r"]).select("u", "v", "d")


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("vec").combine_chunks().flatten().to_numpy().reshape(len(t), -1)


def umap(models: DataFrame, registry: Registry, dims: int = 2, k: int = L.NEIGHBOURS, seed: int = 42) -> DataFrame:
    """As ``layout.umap`` of all aligned profiles, with exact neighbours. Models are numbered by class, so that a shard's neighbours are mostly its own."""
    of = _named(models, registry)
    number = durable(number_rows(of, "class", "model_id", name="i").withColumn("i", (F.col("i") - 1).cast("long")))
    p = durable(pairs(classes(models, registry), registry).select("e_model_id", "e_n", "a_model_id", "score"))
    start = number.join(C.embed(_profiles(p), dims, weight="n").withColumnRenamed("model_id", "class"), "class").drop("class", "i")
    if number.count() <= L.SKETCH:  # whole profiles
        each = p.select("e_model_id", "a_model_id", "score").join(number.select("i", F.col("class").alias("a_model_id")), "a_model_id")
        vectors = each.groupBy(F.col("e_model_id").alias("class")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "score"))), lambda x: F.bround(x["score"], 6)).alias("vec"))
    else:
        vectors = sketches(p, number, L.SKETCH, seed)
    return L.lay_out(number.select("model_id", "i"), start, lambda: neighbours(number, vectors, k, seed), dims, k, seed)
