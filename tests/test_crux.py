"""Golden cruxes of the three-node example; clusters with known shape."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import clusters as C
from causeway.operators import dyads as D
from causeway.operators import expansion as X
from causeway.operators import models as M
from causeway.operators import profiles as P
from causeway.operators.crux import Crux
from causeway.errors import CruxError
from causeway.sources import registry as R


@pytest.fixture(scope="module")
def f2(spark):
    reg = R.build([{"name": "Z", "timing": 1}, {"name": "X", "timing": 2}, {"name": "Y", "timing": 3}], exposure="X", outcome="Y")
    return reg, M.pack(X.exhaustive(spark, reg), reg).persist()


def test_similarity(f2):
    reg, m = f2
    crux = Crux(m, reg)
    assert round(crux.baseline, 6) == 0.693386
    rows = crux.rank().orderBy("rank").collect()
    assert [r["component_id"] for r in rows] == ["C0004", "C0005"]
    for r in rows:
        assert (r["delta_u_causal"], r["delta_u_non_causal"], r["post_compatibility_causal"]) == (0.019577, 0.019577, 0.712963)
        assert (r["dyads_improved_causal"], r["dyads_worsened_causal"], r["models_changed_causal"], r["mapping_coverage_causal"], r["best_resolution"]) == (24, 18, 3, 1.0, "causal")
    for status in ("causal", "non-causal"):
        g = crux.everything(status)
        assert (g["post_compatibility"], g["compatibility_change"], g["dyads_improved"], g["dyads_worsened"], g["models_changed"], g["unknown_instances_forced"]) == (0.730159, 0.036773, 36, 24, 5, 6)
    after = crux.resolved_pairs("C0004", "causal").agg(F.avg("score")).first()[0]
    assert round(after, 6) == 0.712963
    top = crux.synergy()[0]
    assert top["components"] == ["C0004", "C0005"] and top["delta_u_combined"] == 0.036773 and top["synergy_score"] == round(0.036773 - 2 * 0.019577, 6)
    assert crux.synergy(mode="beam")[0]["delta_u_combined"] == 0.036773
    with pytest.raises(CruxError):
        Crux(m.where("model_id <> 'M0001'"), reg).rank()


def test_adjustment(f2):
    reg, m = f2
    crux = Crux(m, reg, "mas_compatible", P.build(m, reg, "X", "Y"))
    for r in crux.rank().collect():
        assert (r["delta_u_causal"], r["delta_u_non_causal"], r["best_resolution"]) == (0.027778, 0.305556, "non-causal")
    assert [crux.everything(s)["post_compatibility"] for s in ("causal", "non-causal")] == [0.444444, 0.777778]
    assert crux.two_stage(Crux(m, reg), threshold=0.0).count() == 2 and crux.baseline == pytest.approx(20 / 72)


def test_clusters(spark):
    ids = [f"M{i:02d}" for i in range(12)]
    group = {m: 0 if i < 6 else 1 for i, m in enumerate(ids)}
    scores = spark.createDataFrame([(a, b, 0.9 if group[a] == group[b] else 0.1) for a in ids for b in ids if a != b], "ego_id string, alter_id string, score double")
    got = C.detect(scores, eps=0.5, min_samples=3)
    assert {r["model_id"]: r["cluster"] for r in got.collect()} == group
    c = {r["cluster_id"]: r for r in C.contrast(scores, got, "M00").collect()}
    assert c["Cluster_01"]["label"] == "mainstream" and c["Cluster_02"]["label"] == "ghost" and c["Cluster_02"]["representative_models"] == ["M06", "M07", "M08"]
    assert C.ghosts(C.contrast(scores, got, "M00")).first()["top_ghost"] == "Cluster_02"
    assert C.detect(scores.withColumn("score", F.lit(1.0))) is None
    line = spark.createDataFrame([(f"p{i}", float(x), 0.0) for i, x in enumerate([0, 1, 2, 3, 10, 11, 12, 50, 6.5])], "model_id string, x double, y double")
    out = {r["model_id"]: r["cluster"] for r in C.dbscan(line, eps=1.0, min_samples=3).collect()}
    assert out == {"p0": 0, "p1": 0, "p2": 0, "p3": 0, "p4": 1, "p5": 1, "p6": 1, "p7": None, "p8": None}
    with pytest.raises(C.ClusterError):
        C.complete(scores.limit(5))


def test_embeddings_by_rounds_and_by_one_task(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2)) * [3, 1]
    d = 1 / (1 + np.linalg.norm(x[:, None] - x[None], axis=2))
    scores = spark.createDataFrame([(f"m{i:02}", f"m{j:02}", float(d[i, j])) for i in range(40) for j in range(40) if i != j], "ego_id string, alter_id string, score double")
    p = C.profiles(scores)
    one, many = (C.embed(p, 3, most).orderBy("model_id").toPandas()[["x", "y", "z"]].to_numpy() for most in (100, 10))
    assert np.abs(one - many).max() < 1e-6


def by_definition(x, eps, least):
    """Clusters of points by search through all pairs."""
    import numpy as np

    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = k
                    todo.append(j)
            k += 1
    return [int(label[i]) if core[i] else min((int(label[j]) for j in np.flatnonzero(near[i] & core)), default=None) for i in range(len(x))]


def clustered(spark, x, eps, least):
    pts = spark.createDataFrame([(f"p{i:05}", *map(float, r)) for i, r in enumerate(x)], "model_id string, " + ", ".join(f"c{i} double" for i in range(x.shape[1])))
    return [r["cluster"] for r in C.dbscan(pts, eps, least).orderBy("model_id").collect()]


def test_clusters_are_those_of_the_definition(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    for d in (2, 3):
        x = np.round(np.concatenate([rng.normal(c, 0.25, (30, d)) for c in (0, 1.5, 4)] + [rng.uniform(-2, 6, (40, d))]), 2)
        assert clustered(spark, x, 0.4, 4) == by_definition(x, 0.4, 4)
    line = np.round(rng.uniform(0, 30, (150, 1)), 1)
    assert clustered(spark, line, 0.2, 3) == by_definition(line, 0.2, 3)


def test_full_cells_touch_as_their_points_do(spark):
    """Discs of many points that part by almost eps, by exactly eps, and by more; some points many times."""
    import numpy as np

    rng = np.random.default_rng(2)
    turn = rng.uniform(0, 2 * np.pi, 400)
    disc = np.stack([np.cos(turn), np.sin(turn)], axis=1) * np.sqrt(rng.uniform(0, 1, 400))[:, None] * 0.3
    disc[0], disc[1] = (0.3, 0), (-0.3, 0)
    for gap in (0.999, 1.0, 1.001):
        x = np.concatenate([disc, disc + [0.6 + gap, 0], disc + [0, 5], disc[:3] + [0, 6.3], np.repeat(disc[:2] + [9, 9], 6, axis=0)])
        got = clustered(spark, x, 1.0, 5)
        assert got == by_definition(x, 1.0, 5) and len({*got} - {None}) == (3 if gap < 1 else 4 if gap > 1 else len({*by_definition(x, 1.0, 5)} - {None}))


def test_a_million_models_at_fifty_places(spark):
    import time

    places = spark.range(1_000_000).selectExpr("format_string('m%07d', id) as model_id", "cast(id % 50 as double) as x", "cast(id % 50 div 10 as double) * 3 as y")
    began = time.perf_counter()
    got = C.dbscan(places, 1.5, 5).groupBy("cluster").count().collect()
    assert sorted((r["cluster"], r["count"]) for r in got) == [(i, 200_000) for i in range(5)] and time.perf_counter() - began < 60


def test_models_without_coordinates_are_noise(spark):
    rows = [(f"a{i}", 0.0, 0.0) for i in range(5)] + [("n", None, 0.0), ("o", float("nan"), 0.0), ("p", float("inf"), 0.0), ("q", -0.0, 0.1)]
    got = {r["model_id"]: r["cluster"] for r in C.dbscan(spark.createDataFrame(rows, "model_id string, x double, y double"), 0.5, 5).collect()}
    assert got == {**{f"a{i}": 0 for i in range(5)}, "n": None, "o": None, "p": None, "q": 0}
    assert C.dbscan(spark.createDataFrame([], "model_id string, x double, y double")).collect() == []


def test_components_of_chains_and_stars(spark):
    from causeway.functions.components import components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_pair_summaries_as_by_pairs(spark):
    from itertools import combinations

    from causeway.errors import DyadError
    from causeway.operators import summaries as U

    sets = [[["A"], ["B"]], [["A"]], [["A"]], [["B"]], [], None, [[]], [["A"], ["B"]]]
    nodes = [["X", "Y"], ["X"], ["X", "Z"], None, ["X", "Y"], ["X"], ["Z"], ["X"]]
    known = [True, True, False, True, True, True, None, True]
    p = spark.createDataFrame([(f"m{i}", s, k, n) for i, (s, k, n) in enumerate(zip(sets, known, nodes, strict=True))], "model_id string, robust_mas array<array<string>>, identified boolean, nodes array<string>")
    sole = {}
    for a, b in combinations([{tuple(z) for z in s} for s in sets if s is not None], 2):
        if len(a & b) == 1:
            z = ", ".join(next(iter(a & b)))
            sole[z] = sole.get(z, 0) + 1
    got = U.adjustment_prevalence(p)
    assert {r["adjustment_set"]: r["sole_in_pairs"] for r in got.collect() if r["sole_in_pairs"]} == sole
    assert U.most_prevalent(got).first().asDict() == {"most_common": "{A}", "models": 4, "sole": "{A}", "sole_in_pairs": sole["A"]}
    miss = {}
    for a, b in combinations([set(n) for n, k in zip(nodes, known, strict=True) if k and n is not None], 2):
        for x in a ^ b:
            miss[x] = miss.get(x, 0) + 1
    assert {r["node"]: r["pairs"] for r in U.missing_components(p).collect()} == miss
    twice = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.5)], "ego_id string, alter_id string, score double")
    with pytest.raises(DyadError):
        U.shift(twice, twice)
    share = U.compatibility_share(spark.createDataFrame([(True,), (None,), (False,)], "ok boolean"), "ok").first()
    assert (share["available"], share["pairs"], share["compatible"], share["share"]) == (2, 3, 1, 0.5)
