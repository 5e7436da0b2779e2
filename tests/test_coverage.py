"""Completions counted against completions listed."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.errors import StateError
from causeway.functions.graphs import Graph
from causeway.operators import models as M
from causeway.operators import signatures as S
from causeway.sources import registry as R


def models(spark, reg, n, seed, open_share):
    g = np.random.default_rng(seed)
    rows = []
    for m in range(n):
        own = [r for r in reg.nodes if g.random() < 0.85]
        there = {r["source"] for r in own}
        rows += [(f"m{m:03}", r["comp_id"], "present", int(g.integers(1, 4)) if g.random() < 0.2 else None) for r in own]
        for r in reg.edges:
            if {r["source"], r["target"]} <= there and g.random() > open_share:
                rows.append((f"m{m:03}", r["comp_id"], "non-causal" if g.random() < 0.7 else "causal", None))
        rows.append((f"m{m:03}", reg.nodes[0]["comp_id"], "present", None)) if not own else None
    return M.pack(spark.createDataFrame(rows, "model_id string, comp_id string, status string, timing int"), reg)


def listed(m, reg):
    per = S.matched(m, reg).groupBy("model_id").agg(F.count("*").alias("e"), F.count("descendant").alias("r"))
    return {r["model_id"]: (r["e"] or 0, r["r"] or 0) for r in m.select("model_id").join(per, "model_id", "left").collect()}


@pytest.mark.parametrize("one_way", [True, False])
def test_counts_equal_listing(spark, one_way):
    names = ["a", "b", "c", "d"]
    allowed = [{"source": a, "target": b, "direction": "->", "rule": "allow"} for a, b in product(names, names) if a < b or (not one_way and a != b)]
    reg = R.build([{"name": x} for x in names], constraints=allowed)
    few = models(spark, reg, 150, 1, 0.25 if one_way else 0.12)
    m = few.union(few.where("model_id < 'm060'").withColumn("model_id", F.concat(F.lit("x"), "model_id"))).cache()
    want = listed(m, reg)
    got = {r["model_id"]: (int(r["expected"]), r["represented"]) for r in S.coverage(m, reg).collect()}
    assert got == want and sum(r for _, r in want.values()) > 30 and max(e for e, _ in want.values()) > 4


def test_fixed_edges(spark):
    reg = R.build([{"name": x} for x in "XYZ"], exposure="X", outcome="Y", constraints=[{"source": "X", "target": "Y", "direction": "->", "rule": "require"}, {"source": "Z", "target": "X", "direction": "->", "rule": "allow"}])
    rows = []
    for m, own in {"p": [], "q": ["non-causal"], "r": ["causal"]}.items():
        rows += [(m, r["comp_id"], "present", None) for r in reg.nodes] + [(m, reg.edges[0]["comp_id"], s, None) for s in own]
    m = M.pack(spark.createDataFrame(rows, "model_id string, comp_id string, status string, timing int"), reg)
    assert {r["model_id"]: (int(r["expected"]), r["represented"]) for r in S.coverage(m, reg).collect()} == listed(m, reg)


def test_forty_open_edges(spark):
    names = [f"n{i:02}" for i in range(10)]
    allowed = [{"source": a, "target": b, "direction": "->", "rule": "allow"} for a, b in product(names, names) if a < b]
    reg = R.build([{"name": x} for x in names], constraints=allowed)
    rows = [("open", r["comp_id"], "present", None) for r in reg.nodes] + [("open", r["comp_id"], "causal", None) for r in reg.edges[:5]]
    for k in range(7):
        rows += [(f"done{k}", r["comp_id"], "present", None) for r in reg.nodes] + [(f"done{k}", r["comp_id"], "causal" if i < 5 - (k == 6) or i == 10 + k else "non-causal", None) for i, r in enumerate(reg.edges)]
    m = M.pack(spark.createDataFrame(rows, "model_id string, comp_id string, status string, timing int"), reg)
    d = {r["model_id"]: r for r in S.diagnostics(m, reg).collect()}
    assert (int(d["open"]["expected"]), d["open"]["represented"], d["open"]["coverage_complete"]) == (2**40, 6, False)
    assert all(d[f"done{k}"]["coverage_complete"] and int(d[f"done{k}"]["expected"]) == 1 for k in range(7))
    with pytest.raises(Exception, match="at most 16"):
        S.completions(m, reg).count()


def test_choices_without_circles():
    g = np.random.default_rng(3)
    for _ in range(60):
        n = int(g.integers(2, 6))
        edges = [(a, b) for a in range(n) for b in range(n) if a != b and g.random() < 0.5][:11]
        required = {e for e in edges if g.random() < 0.2}
        optional = [e for e in edges if e not in required]
        if Graph(n, required).acyclic():
            want = sum(Graph(n, required | {e for e, on in zip(optional, pick, strict=True) if on}).acyclic() for pick in product((0, 1), repeat=len(optional)))
            assert S.count_without_circles(n, required, optional) == want
    every = lambda n: [(a, b) for a in range(n) for b in range(n) if a != b]
    assert [S.count_without_circles(n, set(), every(n)) for n in range(1, 8)] == [1, 3, 25, 543, 29281, 3781503, 1138779265]  # labelled acyclic graphs
    with pytest.raises(StateError, match="circles"):
        S.count_without_circles(16, set(), every(16))
