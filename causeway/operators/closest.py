"""The most similar pairs of models, without comparing all of them.

Models with equal packed sets form a class, and of a class only the first ``top_k`` + 1 ids can be in a result of ``top_k`` pairs. Classes lie in
buckets by how many nodes and claims they have. Two buckets bound the similarity of their classes: shared claims are at most
the smaller of their counts, and the union is at least the larger. Pairs of buckets are opened from the highest bound down, some
more each time, until the ``top_k``-th score found is above all bounds that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.errors import DyadError
from causeway.functions.durable import durable
from causeway.operators import dyads as D
from causeway.sources.registry import Registry

#: Buckets are made coarser until there are at most so many: their pairs are a table of half its square.
BUCKETS = 2048
#: Class pairs that are compared at first, at least; each further opening may take twice as many.
FIRST = 1 << 20
#: Bounds are rounded up to one of so many steps.
STEPS = 1024
_SALTS = 64


def _first_ids(own: DataFrame, n: int) -> DataFrame:
    """The first n ids of each class; a class that very many models share is cut down in shares first."""
    for salts in (_SALTS, 1):
        w = Window.partitionBy("class", F.pmod(F.xxhash64("model_id"), F.lit(salts))).orderBy("model_id")
        own = own.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")
    return own


def _buckets(classes: DataFrame, counts: list[str]) -> DataFrame:
    """Classes with a bucket each: those whose counts agree, up to a step that leaves few enough buckets."""
    step = 1
    while True:
        keyed = classes.withColumn("bucket", F.struct(*(F.floor(F.col(c) / step).alias(c) for c in counts)))
        if step > 64 or keyed.select("bucket").distinct().count() <= BUCKETS:
            return keyed
        step *= 2


def _bounded(buckets: DataFrame, sets: int) -> DataFrame:
    """Pairs of buckets (b1, b2) with the bound of their classes' similarity, as a step, and how many class pairs they hold."""
    one = buckets.select(*(F.col(c).alias(f"{c}1") for c in buckets.columns))
    two = buckets.select(*(F.col(c).alias(f"{c}2") for c in buckets.columns))
    both = one.join(F.broadcast(two), F.col("bucket1") <= F.col("bucket2"))  # at most BUCKETS rows
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    shared = total(F.least(F.col(f"hi_s{i}1"), F.col(f"hi_s{i}2")) for i in range(sets))
    union = total(F.greatest(F.col(f"lo_{k}{i}1"), F.col(f"lo_{k}{i}2")) for k in "pc" for i in range(sets // 3))
    same = F.col("bucket1") == F.col("bucket2")
    union = union + same.cast("int")  # two classes differ in one place at least; in different buckets the counts may tell already
    rate = F.when(union <= 0, 1.0).otherwise(F.least(F.lit(1.0), shared / union))
    n = F.when(same, F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2")).cast("long")
    return both.select("bucket1", "bucket2", F.ceil(rate * STEPS).cast("int").alias("step"), n.alias("pairs")).where("pairs > 0")


def most_similar(models: DataFrame, registry: Registry, top_k: int, first: int = FIRST) -> tuple[DataFrame, dict]:
    """(ego_id, alter_id) of the ``top_k`` most similar ordered pairs, ties by ids; and how many pairs of classes were compared, of how many."""
    if top_k <= 0:
        raise DyadError("top_k must be positive", "INVALID_TOP_K")
    k = registry.words
    names = [f"{s}{i}" for s in ("np", "app", "cm", "xm") for i in range(k)]
    size = [F.bit_count(f"{s}{i}").alias(f"s{j * k + i}") for j, s in enumerate(("np", "cm", "xm")) for i in range(k)]
    least = [F.bit_count(f"np{i}").alias(f"p{i}") for i in range(k)] + [F.bit_count(F.col(f"cm{i}").bitwiseOR(F.col(f"xm{i}")).bitwiseAND(F.col(f"app{i}"))).alias(f"c{i}") for i in range(k)]
    classes = durable(models.groupBy(*names).agg(F.count("*").alias("models"), F.min("model_id").alias("first")).withColumn("class", F.monotonically_increasing_id()))
    ids = durable(_first_ids(models.join(classes.select(*names, "class"), names).select("class", "model_id"), top_k + 1))
    counts = [f"s{i}" for i in range(3 * k)] + [f"{x}{i}" for x in "pc" for i in range(k)]
    placed = durable(_buckets(classes.select("*", *size, *least), counts))
    limits = [F.max(f"s{i}").alias(f"hi_s{i}") for i in range(3 * k)] + [F.min(f"{x}{i}").alias(f"lo_{x}{i}") for x in "pc" for i in range(k)]
    todo = durable(_bounded(placed.groupBy("bucket").agg(F.count("*").alias("n"), *limits), 3 * k))
    steps = [(r["step"], r["n"]) for r in todo.groupBy("step").agg(F.sum("pairs").alias("n")).orderBy(F.desc("step")).collect()]  # a row a step

    side = lambda p: placed.select(*(F.col(c).alias(f"{p}{c}") for c in [*names, "class", "first", "bucket"]))
    c = D.counters(registry)
    rate = D.similarity(c["shared"], c["union_claims"])
    one, other = F.least("e_first", "a_first"), F.greatest("e_first", "a_first")

    def best(pairs: DataFrame) -> DataFrame:
        """Of class pairs those that may give the first pairs: by score, then the first ids in them."""
        return pairs.select(F.col("e_class").alias("c1"), F.col("a_class").alias("c2"), rate.alias("score"), one.alias("id1"), other.alias("id2")).orderBy(F.desc("score"), "id1", "id2").limit(top_k)

    def listed(found: DataFrame) -> DataFrame:
        """The first model pairs of these class pairs."""
        ways = found.select("c1", "c2", "score").union(found.where("c1 <> c2").select("c2", "c1", "score"))
        pairs = ways.join(ids.select(F.col("class").alias("c1"), F.col("model_id").alias("ego_id")), "c1").join(ids.select(F.col("class").alias("c2"), F.col("model_id").alias("alter_id")), "c2")
        return pairs.where("ego_id <> alter_id").orderBy(F.desc("score"), "ego_id", "alter_id").limit(top_k)

    own = side("e_").join(side("a_"), F.col("e_class") == F.col("a_class"))
    many = classes.where("models > 1").select(F.col("class").alias("e_class"))
    found = durable(best(own.join(many, "e_class", "left_semi")))
    compared, at, budget = 0, 0, first
    while True:
        r = listed(found).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        floor = r["s"] if r["n"] == top_k else -1.0
        if at == len(steps) or steps[at][0] / STEPS < floor:
            break
        low, n = at, 0
        while at < len(steps) and steps[at][0] / STEPS >= floor and (at == low or n + steps[at][1] <= budget):
            n += steps[at][1]
            at += 1
        open_ = todo.where(F.col("step").between(steps[at - 1][0], steps[low][0]))
        pairs = open_.join(side("e_"), F.col("bucket1") == F.col("e_bucket")).join(side("a_"), F.col("bucket2") == F.col("a_bucket"))
        pairs = pairs.where((F.col("bucket1") < F.col("bucket2")) | (F.col("e_class") < F.col("a_class")))
        found = durable(found.union(best(pairs)).orderBy(F.desc("score"), "id1", "id2").limit(top_k))
        compared, budget = compared + n, 2 * budget
    return listed(found).select("ego_id", "alter_id"), {"compared": compared, "class_pairs": sum(n for _, n in steps)}

