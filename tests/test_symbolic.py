"""Formulas, counts and classes against enumeration."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import graphs as G
from causeway.plans import formulas as B
from causeway.plans import symbolic as S


def test_formulas():
    x, y, z = map(B.var, "xyz")
    f = B.disj(B.conj(x, B.neg(y)), z)
    assert B.evaluate(f, {"z": True}) is True and B.evaluate(f, {"x": False}) is None and B.evaluate(f, {"x": False, "z": False}) is False
    assert B.conj(x, B.neg(x)) == B.FALSE and B.disj() == B.FALSE and B.neg(B.neg(x)) == x and B.settle(f, {"z": True}) == B.TRUE
    assert B.models(f, ["x", "y", "z"]) == sum(bool(B.evaluate(f, dict(zip("xyz", v, strict=True)))) for v in product((False, True), repeat=3))
    assert B.models(B.TRUE, [str(i) for i in range(78)]) == 2**78


def test_masses_of_scenarios(spark):
    for which, mass, entropy in (("illusion", 4, 2.0), ("lynchpin", 2, 1.0), ("ghost", 2, 1.0)):
        classes, shape = S.scenario(spark, which)
        r = shape.first()
        assert (r["mass"], r["classes"], r["entropy"]) == (mass, mass, entropy)
        assert all(c["empty_adjustment_valid"] for c in classes.collect())
    u = S.paper_small()
    c, _ = S.constraints(u, absent=[e for e in u.edges if e not in u.fixed and e != ("C", "D")])
    r = S.crux(spark, u, c, most_atoms=8).first()
    assert (r["component_id"], r["baseline_entropy"], r["delta_u"], r["entropy_if_present"]) == ("e__C__D", 1.0, 1.0, 0.0)


def test_identifiability_is_that_of_graphs(spark):
    u = S.from_nodes([{"name": n, "timing": i} for i, n in enumerate("ABXY")], "X", "Y")
    index = S.Index(u)
    at = {n: i for i, n in enumerate("ABXY")}
    for on in product((False, True), repeat=len(u.edges)):
        values = dict(zip(u.names, on, strict=True))
        g = G.Graph(4, {(at[a], at[b]) for (a, b), k in zip(u.edges, on, strict=True) if k})
        back = G.Graph(4, {e for e in g.directed if e[0] != at["X"]})
        for z, f in index.valid.items():
            assert B.evaluate(f, values) == G.separated(back, at["X"], at["Y"], sum(1 << at[n] for n in z))
    classes = S.query_classes(spark, u, B.TRUE)
    assert classes.agg({"mass": "sum"}).first()[0] == 64 == sum(r["mass"] for r in classes.collect())
    few = S.query_classes(spark, u, B.TRUE, most_edges=2)
    assert few.agg({"mass": "sum"}).first()[0] == 1 + 6 + 15
    some = S.query_classes(spark, u, B.TRUE, most_free=3, samples=500)
    assert some.agg({"mass": "sum"}).first()[0] == 500
    both = {r["side"]: r for r in S.compare(spark, u, B.TRUE, B.conj(u.edge("A", "X"), u.edge("A", "Y"))).collect()}
    assert both["other"]["mass"] == 16 and both["one"]["necessarily_identifiable"]
    with pytest.raises(S.CausalError):
        S.Universe(["A", "B"], [("A", "B"), ("B", "A")], "A", "B")


def test_many_words_are_drawn_evenly(spark):
    u = S.template("paper_13")  # 78 variables
    u.fixed = set()
    s = S.space(spark, u, B.TRUE, samples=4000)
    assert not s.exact and s.words == ["a0", "a1"] and len(s.bit) == 78
    shares = s.df.agg(*(F.avg(s.on(n).cast("int")).alias(n) for n in s.bit)).first().asDict()
    assert all(0.45 < v < 0.55 for v in shares.values())
    pairs = s.df.select(*(s.on(u.names[i]).alias(f"v{i}") for i in (5, 67, 6, 70, 62, 63))).toPandas()
    assert abs(pairs.astype(float).corr().to_numpy() - np.eye(6)).max() < 0.08
    got = S.sample(spark, u, B.conj(u.edge("A", "Y"), B.neg(u.edge("X", "Y"))), 20)
    assert got.count() == 20 and all(("A", "Y") in {tuple(e) for e in r["edges"]} and ("X", "Y") not in {tuple(e) for e in r["edges"]} for r in got.collect())


def test_counts_by_diagrams(spark):
    u = S.from_nodes([{"name": n, "timing": i} for i, n in enumerate("ABXY")], "X", "Y")
    index = S.Index(u)
    by = {r["class_id"]: r["mass"] for r in S.query_classes(spark, u, B.TRUE, index=index).collect()}
    exact = S.query_classes(spark, u, B.TRUE, index=index, most_free=3, mode="full")
    assert {r["class_id"]: r["mass"] for r in exact.collect()} == by and all(r["exact"] for r in exact.collect())
    some = S.query_classes(spark, u, B.TRUE, index=index, most_free=3, most_nodes=2, samples=300, mode="full")
    assert not any(r["exact"] for r in some.collect())
    assert S.count(u, index.valid[frozenset()]) + S.count(u, B.neg(index.valid[frozenset()])) == 64
    assert S.satisfiable(u, index.identifiable) and not S.satisfiable(u, B.conj(u.edge("A", "B"), B.neg(u.edge("A", "B"))))
    big = S.template("paper_13")
    assert S.count(big, B.TRUE) == 2**78 and S.count(big, big.edge("A", "Y")) == 2**77
    with pytest.raises(B.TooLarge):
        S.count(u, index.valid[frozenset()], most_nodes=1)


def test_constraints_and_orders():
    u = S.from_nodes([{"name": n, "timing": i} for i, n in enumerate("ABXY")], "X", "Y")
    assert S.variable_order(u)[:2] == ["e__A__B", "e__A__X"]
    assert S.count(u, S.sparse(u, most_edges=2)) == 1 + 6 + 15
    inward = sum(1 for on in product((0, 1), repeat=6) if all(sum(o for (s, t), o in zip(u.edges, on, strict=True) if t == n) <= 1 for n in u.nodes))
    assert S.count(u, S.sparse(u, most_into=1)) == inward and S.count(u, S.sparse(u, most_edges=0)) == 1
    assert S.count(u, S.of_graph(u, [("A", "X")])) == 1 and S.count(u, S.of_graph(u, [("A", "X")], "unknown")) == 32
    assert S.count(u, S.of_statuses(u, [{"comp_id": "S0001", "status": "causal"}, {"comp_id": "S0002", "status": "non-causal"}, {"comp_id": "S0003", "status": "unknown"}])) == 16
    most = B.at_most(1, ["a", "b"])
    assert B.evaluate(most, {"a": True}) is None and B.evaluate(most, {"a": False}) is True and B.evaluate(most, {"a": True, "b": True}) is False
    v = S.from_hypothesis([("A", "X"), ("X", "Y")], timing={"A": 1, "X": 2, "Y": 3}, exposure="X", outcome="Y")
    assert v.nodes == ["A", "X", "Y"] and v.edges == [("A", "X"), ("A", "Y"), ("X", "Y")]


def test_preferred_and_decoded(spark):
    u = S.from_nodes([{"name": n, "timing": i} for i, n in enumerate("AXY")], "X", "Y")
    both = S.of_graph(u, [("A", "X"), ("A", "Y"), ("X", "Y")])
    r, classes = S.preferred(spark, u, both)
    r = r.first()
    assert r["mass"] == 1 and r["necessarily_identifiable"] and not r["empty_adjustment_valid"] and r["always_valid_sets"] == [["A"]] and r["agreeing_share"] == 1.0
    assert classes.agg({"mass": "sum"}).first()[0] == 8
    (d,) = S.decoded(S.space(spark, u, both), u).collect()
    assert {tuple(e) for e in d["edges"]} == {("A", "X"), ("A", "Y"), ("X", "Y")} and d["nodes"] == ["A", "X", "Y"]
    assert all(x["compatible"] for x in S.compare(spark, u, both, B.TRUE).collect())


def test_metrics_of_scenarios(spark):
    for size, consensus in (("paper_small", 0.8667), ("paper_13", round(76 / 78, 4))):
        m = S.scenario_metrics(spark, "illusion", size=size)
        assert m["surface_structural_consensus"] == consensus and m["classes_count"] >= 2
    m = S.scenario_metrics(spark, "illusion")
    assert (m["query_class_entropy"], m["causal_compatibility"], m["consensus_gap"], m["classes_count"]) == (2.0, 0.25, 0.6167, 4)
    m = S.scenario_metrics(spark, "lynchpin")
    assert (m["baseline_entropy"], m["phase_transition_score"], m["post_resolution_expected_entropy"], m["lynchpin_rank"]) == (1.0, 1.0, 0.0, 1)
    m = S.scenario_metrics(spark, "ghost")
    assert (m["classes_detected"], m["ghost_class_count"], m["ghost_total_mass"], m["largest_ghost_prior_overlap"]) == (2, 1, 1.0, 0.0)
    with pytest.raises(S.CausalError):
        S.scenario(spark, "crux_of_certainty")
