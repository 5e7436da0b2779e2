"""The most similar pairs by bounds against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import closest, models as M
from causeway.operators import dyads as D
from causeway.sources import registry as R


def made(spark, n, nodes, seed, equal=0):
    """Random models over a registry of so many nodes and an edge for each two of them."""
    g = np.random.default_rng(seed)
    names = [f"n{i:02}" for i in range(nodes)]
    reg = R.build([{"name": x} for x in names], constraints=[{"source": a, "target": b, "direction": "->", "rule": "allow"} for i, a in enumerate(names) for b in names[i + 1 :]])
    rows = []
    for m in range(n):
        g_ = np.random.default_rng(7) if m < equal else g
        own = [r for r in reg.nodes if g_.random() < 0.7]
        there = {r["source"] for r in own}
        rows += [(f"m{m:04}", r["comp_id"], "present", None) for r in own]
        rows += [(f"m{m:04}", r["comp_id"], str(g_.choice(["causal", "non-causal", "unknown"])), None) for r in reg.edges if {r["source"], r["target"]} <= there]
    claims = spark.createDataFrame(rows, "model_id string, comp_id string, status string, timing int")
    return reg, M.pack(claims, reg).persist()


def by_all_pairs(m, reg, k):
    rate = D.similarity(F.col("shared"), F.col("union_claims"))
    return [(r["ego_id"], r["alter_id"]) for r in D.counts(D.pairs(m, reg), reg).orderBy(rate.desc(), "ego_id", "alter_id").limit(k).collect()]


@pytest.mark.parametrize(("n", "nodes", "equal", "k"), [(60, 4, 0, 25), (50, 6, 0, 300), (40, 12, 9, 100), (30, 3, 30, 40), (5, 4, 0, 100), (1, 3, 0, 5)])
def test_equal_to_all_pairs(spark, n, nodes, equal, k):
    reg, m = made(spark, n, nodes, n + nodes, equal)
    for first in (1, closest.FIRST):
        top, seen = closest.most_similar(m, reg, k, first)
        assert sorted(map(tuple, top.collect())) == sorted(by_all_pairs(m, reg, k)), (n, nodes, first)
        assert seen["compared"] <= seen["class_pairs"]
    m.unpersist()


def test_equal_models_close_all_other_pairs(spark):
    reg, m = made(spark, 60, 5, 3, equal=20)
    top, seen = closest.most_similar(m, reg, 30)
    assert sorted(map(tuple, top.collect())) == sorted(by_all_pairs(m, reg, 30)) and seen["compared"] == 0 < seen["class_pairs"]
    m.unpersist()


def test_bounds_close_most_pairs(spark):
    reg, m = made(spark, 300, 8, 5)
    top, seen = closest.most_similar(m, reg, 5, 500)
    assert sorted(map(tuple, top.collect())) == sorted(by_all_pairs(m, reg, 5)) and seen["compared"] < seen["class_pairs"]
    m.unpersist()


def test_coarser_buckets(spark, monkeypatch):
    monkeypatch.setattr(closest, "BUCKETS", 3)
    reg, m = made(spark, 50, 5, 11)
    top, _ = closest.most_similar(m, reg, 40, 10)
    assert sorted(map(tuple, top.collect())) == sorted(by_all_pairs(m, reg, 40))
    m.unpersist()
