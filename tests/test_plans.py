"""Scenarios, the whole analysis, the older workflow and incremental upkeep."""

import pytest

from causeway.errors import EngineError, ScenarioError
from causeway.operators import dyads as D
from causeway.operators import models as M
from causeway.plans import legacy as L
from causeway.plans import scenarios as S
from causeway.plans.analyze import analyze
from causeway.sources import events as E
from causeway.streaming import incremental as I


def test_illusions(spark):
    r = S.run(spark, "precision_illusion")
    assert (r["dyads"], r["mean_similarity_rate"], r["compatible_dyads"], r["compatibility_rate"], r["gap"]) == (36672, 0.757366, 384, 0.010471, 0.746895)
    r = S.run(spark, "precision_illusion", metric="identified_compatible")
    assert (r["mean_similarity_rate"], r["compatible_dyads"], r["compatibility_rate"], r["gap"]) == (0.678245, 4032, 0.109948, 0.568297)


def test_lynchpin_and_ghost(spark):
    r = S.run(spark, "phase_transition", models=60, components=20)
    assert r["lynchpin_rank"] == 1 and r["delta_u"] > 0
    assert any(x["label"] == "ghost" for x in S.run(spark, "ghost_cluster", models=60, components=30))
    with pytest.raises(ScenarioError):
        S.run(spark, "none")


def test_analysis(spark):
    a = analyze(spark, [{"name": "Z", "timing": 1}, {"name": "X", "timing": 2}, {"name": "Y", "timing": 3}], "X", "Y", mode="exhaustive", prior="M0001")
    s = a.summary()
    assert s["models"] == 9 and round(s["mean_similarity"], 5) == 0.69339 and s["identified"]["identified"] == 9
    assert [r["component_id"] for r in a.crux.orderBy("rank").collect()] == ["C0004", "C0005"]
    assert {r["adjustment_set"]: r["models"] for r in s["adjustment_sets"]} == {"": 5, "Z": 1}


def test_older_workflow(spark):
    nodes, timing, types = ["Y", "Xtest", "X1", "X2"], [0, -1, -3, -2], ["otc", "test", "ctr", "ctr"]
    named = L.roles(nodes, timing, types)
    assert [(r["name"], r["label"]) for r in named] == [("X1", "X1"), ("X2", "X2"), ("Xtest", "Xtest"), ("Y", "Y")]
    assert L.parse(["Y ~ X1 + Xtest; X1 ~~ X2"]) == [(1, "X1", "Y", "->"), (1, "Xtest", "Y", "->"), (1, "X1", "X2", "<->")]
    edges = L.build_causal_node(spark, nodes, timing, types, ["Y ~ Xtest + X1; Xtest ~ X1"]).persist()
    models = edges.select("model").distinct().count()
    assert edges.where("from = 'Xtest' and to = 'Y'").count() >= models and edges.where("user_mod = 1").select("model").distinct().count() == 1
    m = L.build_formula_matrix(edges, ["X1", "X2", "Xtest", "Y"])
    own = edges.where("user_mod = 1").select("model").first()[0]
    r = m.where(f"model = {own}").first()
    assert r["formula"] == "Y ~ X1 + Xtest, Xtest ~ X1" and r["mas"] == [["X1"]] and r["correct_test"] == "yes"
    c = L.add_compatible(m, own)
    assert c.where("test_compatible = 'reference model'").count() == 1 and c.where("test_compatible = 'compatible'").count() > 0
    assert L.find_models(edges, ["Y ~ Xtest + X1; Xtest ~ X1"], named).first()["model"] == own
    assert L.build_set_matrix(edges, m, "correct_test").count() == models
    with pytest.raises(EngineError):
        L.roles(nodes, [0, 1, -3, -2], types)


def test_upkeep(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    reg = E.registry(spark, sf)
    claims = E.claims(spark, sf, reg).persist()
    first = claims.where("model_id <> '2'")
    changed = M.set_status(claims.where("model_id in ('1', '2')"), spark.createDataFrame([("1", "C0014", "non-causal")], "model_id string, comp_id string, status string"))
    for k, part in enumerate((first, changed)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        spark.readStream.schema(claims.schema).parquet(str(tmp_path / "in/*")).writeStream  # noqa: B018
        I.upkeep(spark.readStream.schema(claims.schema).parquet(str(tmp_path / "in/*")), reg, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    want = D.all_pairs(M.pack(claims.where("model_id not in ('1', '2')").unionByName(changed), reg), reg)
    got = I.latest(spark, str(tmp_path / "state")).select(*want.columns)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_matrix_modes(spark):
    from causeway.errors import DyadError
    from causeway.operators import expansion as X
    from causeway.plans import matrix
    from causeway.sources import registry as R

    reg = R.build([{"name": "Z", "timing": 1}, {"name": "X", "timing": 2}, {"name": "Y", "timing": 3}], exposure="X", outcome="Y")
    claims = X.exhaustive(spark, reg).persist()
    assert matrix.dyad_matrix(spark, claims, reg).columns == matrix.BASIC
    full = matrix.dyad_matrix(spark, claims, reg, "full")
    assert full.count() == 72 and full.where("mas_compatible").count() == 20
    assert {r["ego_id"] for r in matrix.dyad_matrix(spark, claims, reg, "single-ref", "M0005").collect()} == {"M0005"}
    top = matrix.dyad_matrix(spark, claims, reg, "two-stage", top_k=16).collect()
    assert len(top) == 16 and {r["similarity_rate"] for r in top} == {0.833333}
    assert matrix.dyad_matrix(spark, None, reg, "symbolic").agg({"mass": "sum"}).first()[0] == 4
    for bad in ({"mode": "single-ref"}, {"mode": "none"}, {"mode": "two-stage", "top_k": 0}, {"exposure": "X", "outcome": None, "mode": "single-ref"}):
        with pytest.raises(DyadError):
            matrix.dyad_matrix(spark, claims, reg, **bad)


def test_older_models_are_moved_and_added(spark):
    nodes, timing, types = ["Y", "Xtest", "X1", "X2"], [0, -1, -3, -2], ["otc", "test", "ctr", "ctr"]
    w = L.run(spark, nodes, timing, types)
    last = w.edges.agg({"model": "max"}).first()[0]
    key = lambda e, m: sorted((r["from"], r["to"]) for r in e.where(f"model = {m}").collect())
    text = "; ".join(f"{b} ~ {a}" for a, b in key(w.edges, 5))
    moved = L.add_models(w.edges, [text], w.nodes, [2]).persist()
    assert key(moved, 2) == key(w.edges, 5) and key(moved, 5) == key(w.edges, 2) and {r["prev_mod"] for r in moved.where("model = 2").collect()} == {5}
    new = "Y ~ Xtest; X1 ~ Y"
    added = L.add_models(w.edges, [new], w.nodes).persist()
    assert key(added, last + 1) == [("Xtest", "Y"), ("Y", "X1")] and added.where("user_mod = 1").select("model").distinct().count() == 1
    put = L.add_models(w.edges, [new], w.nodes, [3]).persist()
    assert key(put, 3) == [("Xtest", "Y"), ("Y", "X1")] and key(put, 4) == key(w.edges, 3) and key(put, 2) == key(w.edges, 2)
    assert L.add_models(w.edges, [new], w.nodes, add=lambda t: False).agg({"model": "max"}).first()[0] == last
    spots = L.plot_places(w.nodes)
    assert spots["Y"] == (1.0, 0.0) and spots["X2"][1] == 0.5 and spots["X1"][1] == 1.25
    assert L.plot_frame(w, [1]).select("model").distinct().count() == 1


def test_older_colliders(spark):
    rows = [(1, "Xtest", "Y", "->"), (1, "Xtest", "X1", "->"), (1, "Y", "X1", "->"), (2, "Xtest", "Y", "->"), (2, "X1", "Y", "->"), (3, "Xtest", "Y", "->"), (3, "Xtest", "X1", "->")]
    e = spark.createDataFrame([(*r, f"{r[1]}_{r[2]}") for r in rows], "model int, from string, to string, direction string, component string")
    m = L.build_formula_matrix(e, ["X1", "Xtest", "Y"], late=["X1"])
    assert {r["model"]: (r["correct_test"], r["unq_nodes"]) for r in m.collect()} == {1: ("no", "X1_Xtest_Y"), 2: ("yes", "X1_Xtest_Y"), 3: ("yes", "X1_Xtest_Y")}
    c = {r["model"]: (r["test_compatible"], r["full_model_compatible"]) for r in L.add_compatible(m, 2).collect()}
    assert c[2] == ("reference model", "reference model") and c[1][1] == "incompatible" and c[3][1] == "compatible"
