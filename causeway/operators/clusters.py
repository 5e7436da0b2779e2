"""Clusters of models by their compatibility profiles, and those that cohere but lie far from a prior model."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.errors import ClusterError
from causeway.functions.components import components
from causeway.functions.durable import durable, number_rows

MOST_EMBEDDED = 5_000


def complete(scores: DataFrame) -> DataFrame:
    """``scores`` (ego_id, alter_id, score), checked: every ordered pair once, all finite."""
    ids = scores.select(F.col("ego_id").alias("id")).union(scores.select("alter_id")).distinct()
    n = ids.count()
    r = scores.agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad")).first()
    distinct = scores.select("ego_id", "alter_id").distinct().count()
    if r["bad"] or r["n"] != distinct or distinct != n * (n - 1):
        raise ClusterError(f"{r['bad']} scores are missing, {r['n'] - distinct} repeated, {n * (n - 1) - distinct} pairs absent", "GHOST_ERROR")
    return scores


def profiles(scores: DataFrame, aligned: bool = True) -> DataFrame:
    """(model_id, profile): a model's scores in the order of the others; ``aligned`` has itself at 1."""
    if aligned:
        ids = scores.select("ego_id").distinct()
        scores = scores.select("ego_id", "alter_id", "score").union(ids.select("ego_id", F.col("ego_id"), F.lit(1.0)))
    return scores.groupBy(F.col("ego_id").alias("model_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("alter_id", F.col("score").cast("double").alias("score")))), lambda x: x["score"]).alias("profile"))


def degeneracy(scores: DataFrame) -> dict:
    r = scores.agg(F.count_distinct("score").alias("unique_values"), F.bool_and(F.col("score") == 1).alias("all_one"), F.bool_and(F.col("score") == 0).alias("all_zero"), F.var_pop("score").alias("variance")).first().asDict()
    return r | {"degenerate": (r["unique_values"] or 0) < 2}


def embed(profiles_: DataFrame, dims: int = 2, most: int = MOST_EMBEDDED, weight: str | None = None) -> DataFrame:
    """(model_id, x, y[, z]): principal components of aligned profiles, with fixed signs. ``layout.umap`` lays models out by neighbourhoods instead.

    Up to ``most`` models are taken apart by one task; more by subspace iteration over all tasks, to the same components.
    ``weight``: column of how many models a row stands for; its place in the profiles stands for as many.
    """
    profiles_ = profiles_.select("model_id", "profile", (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    n = profiles_.count()
    names = ["x", "y", "z"][:dims]
    schema = "model_id string, " + ", ".join(f"{c} double" for c in names)
    if n > most:
        return _embed_by_rounds(profiles_, names, schema, weight is not None)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("model_id")
        p = t.column("profile").combine_chunks().flatten().to_numpy().reshape(len(t), -1).copy()
        w = t.column("w").to_numpy()
        root = w**0.5 if weight else np.ones(p.shape[1])  # of a profile's places
        p *= root
        p -= w @ p / max(w.sum(), 1)
        out = np.zeros((len(p), dims))
        if len(p) > 1:
            u, s, v = np.linalg.svd(p * w[:, None] ** 0.5, full_matrices=False)
            k = min(dims, len(s))
            out[:, :k] = (u[:, :k] * s[:k]) / w[:, None] ** 0.5 * _signs(v[:k] / root)
        return pa.table([t.column("model_id"), *(pa.array(out[:, i]) for i in range(dims))], ["model_id", *names])

    return profiles_.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(run, schema)


def _signs(v: np.ndarray) -> np.ndarray:
    """The sign of each row's largest entry."""
    return np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])


def _embed_by_rounds(profiles_: DataFrame, names: list[str], schema: str, aligned: bool, rounds: int = 200) -> DataFrame:
    """The driver holds a few numbers a place of the profiles (the directions); each profile has as many itself. ``aligned``: places weigh as the models they stand for."""
    profiles_ = durable(profiles_)
    n = profiles_.select(F.size("profile")).first()[0]
    k = min(len(names) + 4, n)
    every = profiles_.agg(F.sum("w")).first()[0]
    root = profiles_.select("model_id", "w").orderBy("model_id").toArrow()["w"].to_numpy() ** 0.5 if aligned else np.ones(n)

    def matrix(x: pa.RecordBatch) -> np.ndarray:
        return x.column(1).flatten().to_numpy().reshape(len(x), -1) * root

    def summed(fn, width: int) -> np.ndarray:
        """Sums over all profiles of fn(profiles, weights) (places by ``width``), added up by place."""

        def run(batches):
            total = np.zeros((n, width))
            for x in batches:
                total += fn(matrix(x), x.column(2).to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *(pa.array(total[:, i]) for i in range(width))], ["at", *(f"c{i}" for i in range(width))])

        cols = [f"c{i}" for i in range(width)]
        rows = profiles_.select("model_id", "profile", "w").mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in cols)).groupBy("at").agg(*(F.sum(c).alias(c) for c in cols)).orderBy("at").toArrow()
        return np.stack([rows[c].to_numpy() for c in cols], axis=1)

    mean = summed(lambda p, w: (w * p).sum(axis=0)[:, None], 1)[:, 0] / every
    v, last = np.linalg.qr(np.random.default_rng(0).normal(size=(n, k)))[0], None
    for _ in range(rounds):
        v = np.linalg.qr(summed(lambda p, w, v=v: (w * (q := p - mean)).T @ (q @ v), k))[0]
        size = np.linalg.norm(v[:, : len(names)] if last is None else v[:, : len(names)] - last @ (last.T @ v[:, : len(names)]))
        if last is not None and size < 1e-9:
            break
        last = v
    gram = np.linalg.eigh(summed(lambda p, w: (w * (q := p - mean)).T @ (q @ v), k).T @ v)  # in the directions found
    turn = (v @ gram[1][:, ::-1])[:, : len(names)]
    turn *= _signs((turn / root[:, None]).T)
    found = turn.shape[1]  # profiles of fewer places have no more components

    def run(batches):
        for x in batches:
            y = (matrix(x) - mean) @ turn
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(y[:, i] if i < found else np.zeros(len(x))) for i in range(len(names)))], ["model_id", *names])

    return profiles_.select("model_id", "profile").mapInArrow(run, schema)


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 5, columns: list[str] | None = None) -> DataFrame:
    """(model_id, cluster): clusters from 0 in the order of their first core model; null is noise. A border model goes to the first of its clusters.

    Models at one place are one point that counts as often. Points lie in cells of a grid whose diagonal is shorter than eps, so
    all points of a cell of ``min_samples`` models are core, and core points of one cell are one node. Points of other cells, fewer than
    ``min_samples`` each, meet the points of the cells around them. Full cells meet each other by boxes (``_touching``). Models
    without finite coordinates are noise.
    """
    if eps <= 0 or min_samples < 2:
        raise ClusterError("eps must be positive and min_samples two at least", "INVALID_EPS")
    cols = columns or [c for c in points.columns if c != "model_id"]
    d, side = len(cols), eps / len(cols) ** 0.5 * (1 - 1e-9)
    cells = [f"cell{i}" for i in range(d)]
    finite = reduce(lambda x, y: x & y, (F.abs(F.col(c).cast("double")) < float("inf") for c in cols))
    placed = points.where(finite).select("model_id", *(F.col(c).cast("double").alias(c) for c in cols))
    at = placed.groupBy(*cols).agg(F.count("*").alias("n"), F.min("model_id").alias("first"))
    at = durable(at.select("*", *(F.floor(F.col(c) / side).alias(k) for c, k in zip(cols, cells, strict=True))))
    full = durable(at.groupBy(*cells).agg(F.sum("n").alias("n"), F.min("first").alias("node")).where(F.col("n") >= min_samples).select(*cells, "node"))
    steps = _steps(d)

    def near(us: DataFrame, vs: DataFrame, *keep: str) -> DataFrame:
        """Pairs of points at most eps apart: the columns of u, and ``keep`` of v as v_."""
        around = F.explode(F.array(*(F.struct(*(F.lit(x).cast("long").alias(k) for x, k in zip(o, cells, strict=True))) for o in steps))).alias("step")
        a = us.select(*us.columns, around).select(*us.columns, *((F.col(k) + F.col(f"step.{k}")).alias(f"to_{k}") for k in cells))
        b = vs.select(*(F.col(c).alias(f"v_{c}") for c in dict.fromkeys([*cols, *keep])), *(F.col(k).alias(f"to_{k}") for k in cells))
        d2 = reduce(lambda x, y: x + y, ((F.col(c) - F.col(f"v_{c}")) ** 2 for c in cols))
        return a.join(b, [f"to_{k}" for k in cells]).where(d2 <= eps * eps)

    sparse = at.join(full, cells, "left_anti").select(*at.columns)
    counted = near(sparse, at, "n").groupBy(*cols).agg(F.sum("v_n").alias("around")).where(F.col("around") >= min_samples)
    alone = durable(sparse.join(counted, cols, "left_semi").select(*at.columns))  # core points of other cells
    nodes = durable(full.select(*cells, "node").union(alone.groupBy(*cells).agg(F.min("first").alias("node"))))
    cores = at.join(full, cells, "left_semi").select(*at.columns).union(alone)
    met = near(alone.join(nodes, cells), cores.join(nodes, cells), "node").select(F.col("node").alias("u"), F.col("v_node").alias("v"))
    dense = at.join(full, cells).select(*cols, *cells, "node")
    edges = met.where("u <> v").distinct().union(_touching(dense, full, cols, cells, eps, side))
    roots = nodes.select("node").join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    roots = durable(roots)
    number = number_rows(roots.select("root").distinct(), "root").select("root", (F.col("n") - 1).cast("int").alias("cluster"))
    of_cell = durable(nodes.join(roots.join(number, "root"), "node").select(*cells, "cluster"))
    others = sparse.join(counted, cols, "left_anti").select(*at.columns)
    border = near(others, cores.join(of_cell, cells), "cluster").groupBy(*cols).agg(F.min("v_cluster").alias("cluster"))
    own = cores.join(of_cell, cells).select(*cols, "cluster").union(border.select(*cols, "cluster"))
    return points.select("model_id").join(placed.join(own, cols).select("model_id", "cluster"), "model_id", "left")


def _steps(d: int) -> list[tuple[int, ...]]:
    """From a cell to those that may hold a point within eps of one of its own."""
    reach = int(d**0.5) + 1
    return [o for o in product(range(-reach, reach + 1), repeat=d) if sum(max(abs(x) - 1, 0) ** 2 for x in o) <= d]


def _touching(points: DataFrame, full: DataFrame, cols: list[str], cells: list[str], eps: float, side: float) -> DataFrame:
    """Edges (u, v) of full cells that have points at most eps apart. ``points``: columns, cells and node; ``full``: cells and node.

    Boxes around the points of a cell are compared. If even their far ends are near, the cells touch; if not even their near ends are,
    these boxes are done; else both are halved along each axis, and the pairs of their parts compared. A box of one point leaves nothing open, so the
    halving ends, and no pairs of points are listed but where cells part by almost eps.
    """
    keys = [f"key{i}" for i in range(len(cols))]
    lows, highs = [f"low_{c}" for c in cols], [f"high_{c}" for c in cols]
    sides = lambda name, w: [F.col(x).alias(f"{w}_{x}") for x in name]

    def boxes(rows: DataFrame, level: int) -> DataFrame:
        at = [F.floor(F.col(c) / side * 2.0**level).alias(k) for c, k in zip(cols, keys, strict=True)]
        return rows.select("node", *cols, *at).groupBy("node", *keys).agg(*(F.min(c).alias(x) for c, x in zip(cols, lows, strict=True)), *(F.max(c).alias(x) for c, x in zip(cols, highs, strict=True)))

    def judged(pairs: DataFrame) -> DataFrame:
        gap = [F.greatest(F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.lit(0.0)) for lo, hi in zip(lows, highs, strict=True)]
        span = [F.greatest(F.col(f"a_{hi}") - F.col(f"b_{lo}"), F.col(f"b_{hi}") - F.col(f"a_{lo}")) for lo, hi in zip(lows, highs, strict=True)]
        least, most = (reduce(lambda x, y: x + y, (x**2 for x in part)) for part in (gap, span))
        return durable(pairs.where(least <= eps * eps).withColumn("sure", most <= eps * eps))

    ahead = [o for o in _steps(len(cols)) if o > (0,) * len(cols)]  # each pair of cells once
    around = F.explode(F.array(*(F.struct(*(F.lit(x).cast("long").alias(k) for x, k in zip(o, cells, strict=True))) for o in ahead))).alias("step")
    a = full.select(F.col("node").alias("a_node"), *cells, around).select("a_node", *((F.col(k) + F.col(f"step.{k}")).alias(k) for k in cells))
    pairs = a.join(full.select(F.col("node").alias("b_node"), *cells), cells).select("a_node", "b_node")
    level, made = 0, boxes(points, 0)
    pairs = pairs.join(made.select(*sides(made.columns, "a")), "a_node").join(made.select(*sides(made.columns, "b")), "b_node")
    found = None
    while True:
        pairs = judged(pairs)
        sure = pairs.where("sure").select("a_node", "b_node").distinct()
        found = sure if found is None else found.union(sure)
        open_ = durable(pairs.where("not sure").join(sure, ["a_node", "b_node"], "left_anti"))
        if open_.isEmpty():
            return found.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))
        level += 1
        held = open_.select(F.col("a_node").alias("node"), *(F.col(f"a_{k}").alias(k) for k in keys)).union(open_.select("b_node", *(f"b_{k}" for k in keys))).distinct()
        before = [F.floor(F.col(c) / side * 2.0 ** (level - 1)).alias(k) for c, k in zip(cols, keys, strict=True)]
        points = durable(points.select("node", *cols, *before).join(held, ["node", *keys], "left_semi").select("node", *cols))
        made = durable(boxes(points, level))
        parent = [F.shiftright(k, 1).alias(f"up_{k}") for k in keys]
        part = made.select(*made.columns, *parent)
        pairs = open_.select("a_node", "b_node", *(F.col(f"{w}_{k}").alias(f"{w}_up_{k}") for w in "ab" for k in keys))
        for w in "ab":
            pairs = pairs.join(part.select(*sides(part.columns, w)), [f"{w}_node", *(f"{w}_up_{k}" for k in keys)])
        pairs = pairs.drop(*(f"{w}_up_{k}" for w in "ab" for k in keys))


def named(assignments: DataFrame) -> DataFrame:
    return assignments.withColumn("cluster_id", F.when(F.col("cluster").isNotNull(), F.format_string("Cluster_%02d", F.col("cluster") + 1)))


def centralities(scores: DataFrame, assignments: DataFrame) -> DataFrame:
    """(cluster_id, model_id, total, pairs): each clustered model's scores with the others of its cluster, in both directions, summed in one pass over the pairs."""
    a = assignments.where("cluster_id is not null").select("model_id", "cluster_id")
    inner = scores.join(a.toDF("ego_id", "cluster_id"), "ego_id").join(a.toDF("alter_id", "c2"), "alter_id").where("cluster_id = c2")
    both = inner.select("cluster_id", F.explode(F.array("ego_id", "alter_id")).alias("model_id"), "score").groupBy("cluster_id", "model_id").agg(F.sum("score").alias("total"), F.count("*").alias("pairs"))
    return a.join(both, ["cluster_id", "model_id"], "left").select("cluster_id", "model_id", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def of_clusters(central: DataFrame) -> DataFrame:
    return central.groupBy("cluster_id").agg(F.count("*").alias("model_count"), F.coalesce(F.try_divide(F.sum("total"), F.sum("pairs")), F.lit(0.0)).alias("internal_compatibility"))


def summaries(scores: DataFrame, assignments: DataFrame, embedding: DataFrame | None = None) -> DataFrame:
    """Per cluster: models, the mean of their ordered pairs (0 for one model), and with the embedding their centroid."""
    out = of_clusters(centralities(scores, assignments))
    if embedding is None:
        return out
    axes = [c for c in embedding.columns if c != "model_id"]
    mid = assignments.where("cluster_id is not null").join(embedding, "model_id").groupBy("cluster_id").agg(F.array(*(F.round(F.avg(c), 6) for c in axes)).alias("centroid"))
    return out.join(mid, "cluster_id", "left")


def detect(scores: DataFrame, eps: float = 0.5, min_samples: int = 5, dims: int = 2, layout: str = "components", seed: int = 42) -> DataFrame | None:
    """(model_id, cluster, cluster_id) on the embedding by principal components or, with ``layout`` "umap", by neighbourhoods; None if the scores are degenerate or the models too few."""
    if layout not in ("components", "umap"):
        raise ClusterError(f"no layout {layout}", "INVALID_LAYOUT")
    scores = complete(scores)
    if degeneracy(scores)["degenerate"] or scores.select("ego_id").distinct().count() < min_samples:
        return None
    if layout == "umap":
        from causeway.operators.layout import umap

        return named(dbscan(umap(profiles(scores), dims, seed=seed), eps, min_samples))
    return named(dbscan(embed(profiles(scores), dims), eps, min_samples))


def contrast(scores: DataFrame, assignments: DataFrame, prior: str, internal: float = 0.6, far: float = 0.4) -> DataFrame:
    """Per cluster: coherence, compatibility with the prior model (its own membership aside), label, and up to three representatives."""
    touch = scores.where(F.col("ego_id") == prior).select(F.col("alter_id").alias("model_id"), "score").union(scores.where(F.col("alter_id") == prior).select("ego_id", "score"))
    return contrasted(durable(centralities(scores, assignments)), touch, assignments, internal, far)


def contrasted(central: DataFrame, touch: DataFrame, assignments: DataFrame, internal: float, far: float) -> DataFrame:
    """``contrast`` from centralities (a row a model) and the scores with the prior model (model_id, score)."""
    s = of_clusters(central)
    a = assignments.where("cluster_id is not null").select("model_id", "cluster_id")
    p = touch.join(a, "model_id").groupBy("cluster_id").agg(F.avg("score").alias("p"))
    prior_score = F.coalesce("p", F.lit(0.0))
    label = F.when(F.col("internal_compatibility") < internal, "fragmented").when(prior_score < far, "ghost").otherwise("mainstream")
    top = most_central(central, 3).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "model_id"))), lambda x: x["model_id"]).alias("representative_models"))
    return s.join(p, "cluster_id", "left").join(top, "cluster_id").select("cluster_id", "model_count", "internal_compatibility", prior_score.alias("prior_compatibility"), (1 - prior_score).alias("prior_distance"), label.alias("label"), "representative_models")


def representatives(scores: DataFrame, assignments: DataFrame, top: int = 3) -> DataFrame:
    """The models most compatible with their cluster; of a small cluster all, by id."""
    return most_central(centralities(scores, assignments), top)


def most_central(central: DataFrame, top: int) -> DataFrame:
    mean = central.select("cluster_id", "model_id", F.coalesce(F.try_divide("total", "pairs"), F.lit(0.0)).alias("centrality"))
    small = mean.groupBy("cluster_id").agg((F.count("*") <= top).alias("_small"))
    order = [F.desc(F.when(F.col("_small"), 0.0).otherwise(F.round("centrality", 9))), "model_id"]  # sums come in any order
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))  # tasks cut their rows to the first ones before a cluster's meet
    return mean.join(small, "cluster_id").withColumn("place", place).where(F.col("place") <= top).select("cluster_id", "model_id", "centrality", "place")


def ghosts(contrast_: DataFrame) -> DataFrame:
    """How many ghost clusters and models there are, and the most coherent one."""
    return contrast_.where("label = 'ghost'").agg(F.count("*").alias("clusters"), F.coalesce(F.sum("model_count"), F.lit(0)).alias("models"), F.max_by("cluster_id", "internal_compatibility").alias("top_ghost"))
