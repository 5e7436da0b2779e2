"""Scenarios of every metric, their frames, seeded inputs, and where plots draw things."""

import pytest
from pyspark.sql import functions as F

from causeway.errors import ScenarioError
from causeway.operators import models as M
from causeway.operators import summaries as U
from causeway.plans import frames as Q
from causeway.plans import scenarios as S
from causeway.sources import registry as R


def test_front_door(spark):
    reg = S.front_door_registry(9, "X1", "Y")
    assert len(reg.rows) == 9 and [r["source"] for r in reg.nodes] == ["__U", "X1", "__M", "Y"] and not reg.nodes[0]["observed"]
    assert len(S.front_door_registry(40, "X1", "Y").rows) == 40
    with pytest.raises(ScenarioError):
        S.front_door_registry(8, "X1", "Y")
    r = S.crux_of_certainty(spark, "identified_compatible", models=12, components=9)
    x = r.results
    # 4 models claim the direct edge: no pair with one is identified; without it all are
    assert x["crux_component_id"] == x["seeded_crux_id"] and x["target_status"] == "non-causal" and x["post_resolution_compatibility"] > x["baseline_compatibility"]
    assert x["completion_support_model_count"] == 0 and x["n_unavailable_dyads"] == 0


def test_confounder(spark):
    r = S.crux_of_certainty(spark, "mas_compatible", models=9, components=6)
    x = r.results
    assert x["crux_matches_seed"] and x["rank"] == 1 and x["mapping_coverage"] == 1.0 and x["models_changed"] == 3
    # settled as absent, the partial models need no adjustment as a third of the others; with it they need the confounder
    assert x["baseline_compatibility"] == round(2 * 2 * 3 / 72, 6) and x["post_resolution_compatibility"] == round((2 * 15 + 2 * 3) / 72, 6)
    with pytest.raises(ScenarioError):
        S.confounder_crux(spark, 9, 6, "X1", "X3")


def test_transition_with_spare_models_and_its_frames(spark):
    claims, reg, key = S.phase_transition(spark, models=32, components=20)
    assert claims.select("model_id").distinct().count() == 32
    states = {r["status"]: r["count"] for r in claims.where(F.col("comp_id") == key).groupBy("status").count().collect()}
    assert states == {"unknown": 10, "causal": 11, "non-causal": 11}
    r = S.crux_of_certainty(spark, models=32, components=20)
    x = r.results
    assert x["phase_transition_score"] > 0 and x["n_dyads"] == 32 * 31
    line = Q.simulation(r)["compatibility_timeline"].orderBy("step_order").collect()
    assert [q["step"] for q in line] == ["baseline", f"resolved_{x['crux_component_id']}"] and line[1]["compatibility"] == x["post_resolution_compatibility"]
    s = Q.showcase(r)
    n = s["shift_summary"].first()
    assert n["improved"] + n["worsened"] + n["unchanged"] == 32 * 31 and abs(n["mean_change"] - x["phase_transition_score"]) < 1e-4
    assert Q.ranking(r.frames["rankings"]).count() >= 1
    g = S.analyze_crux(spark, claims.where(F.col("comp_id") != "none"), reg, crux_mode="global", status="causal")
    assert g.results["crux_mode"] == "global" and g.results["target_status"] == "causal"
    assert U.sample_pairs(r.frames["shift"], 7).exceptAll(U.sample_pairs(r.frames["shift"], 7)).count() == 0 and U.sample_pairs(r.frames["shift"], 7).count() == 7


def test_ghosts_and_their_frames(spark):
    r = S.analyze_ghosts(spark, *S.ghost(spark, models=60, components=30))
    f = Q.simulation(r)
    assert {x["label"] for x in f["cluster_sizes"].collect()} >= {"ghost", "mainstream"} and f["cluster_embedding"].count() == 60
    mid = {x["label"]: x["models"] for x in f["cluster_labels"].collect()}
    assert sum(mid.values()) == 60 and mid["ghost"] == r.results["models"]
    breaks = [x["position"] for x in r.frames["breaks"].orderBy("position").collect()]
    assert breaks[0] == mid["ghost"] + 0.5 and all(b < 60 for b in breaks)
    assert Q.showcase(r)["clustered_dyad_heatmap"].count() == 60 * 59
    labels = r.frames["contrast"].where("label <> 'ghost'")
    assert "unknown" in {x["label"] for x in U.cluster_order(r.frames["assignments"], labels).collect()}


def test_illusion_frames(spark):
    r = S.illusion(spark)
    bars = Q.simulation(r)["precision_comparison"].collect()
    assert [b["value"] for b in bars] == [0.757366, 0.010471]
    assert Q.showcase(r)["consensus_contrast"].count() <= 15
    with pytest.raises(ScenarioError):
        Q.timeline(r)


def test_seeded_inputs(spark):
    claims, reg, _ = S.confounder_crux(spark, 9, 6)
    own, some = S.seeded(reg.rows, claims, 4)
    assert some.select("model_id").distinct().count() == 4 and own.rows == reg.rows
    open_ = S.analyze_crux(spark, *reversed(S.seeded(reg.rows, claims)))
    assert open_.results["analysis_model_count"] == 9
    for rows, c, n in (([], claims, None), (reg.rows, claims.where("model_id = 'M0001'"), None), (reg.rows, claims, 1), (reg.rows, claims, 10)):
        with pytest.raises(ScenarioError):
            S.seeded(rows, c, n)
    both = R.build([{"name": n} for n in "AB"], include_bidirectional=True)
    with pytest.raises(ScenarioError, match="directed"):
        S.seeded(both.rows, claims)
    loop = R.build([{"name": n} for n in "AB"])
    turn = R.claims_frame(spark, [{"model_id": m, "comp_id": r["comp_id"], "status": "causal" if r["type"] == "edge" else "present"} for m in "PQ" for r in loop.rows])
    with pytest.raises(ScenarioError, match="cycle"):
        S.seeded(loop.rows, turn)
    times = spark.createDataFrame([("X12",), ("Y",), ("X",)], "s string").select(S.timing_of(F.col("s"))).collect()
    assert [t[0] for t in times] == [12, 0, 0]


def test_support_makes_metrics_available(spark):
    claims, reg, key = S.confounder_crux(spark, 9, 6)
    partial = claims.where("model_id in ('M0001', 'M0004')")
    models = M.pack(partial, reg)
    with pytest.raises(ScenarioError, match="null"):
        S.metric_pairs(models, reg, "mas_compatible", "X2", "X3")
    _, _, seen = S.metric_pairs(models, reg, "mas_compatible", "X2", "X3", support=True)
    assert seen["completion_support_model_count"] == 2 and seen["n_comparable_dyads"] == 2


def test_places_and_edges_of_models(spark):
    reg = R.build([{"name": "Z", "timing": 1}, {"name": "W", "timing": 1}, {"name": "X", "timing": 2}, {"name": "Y", "timing": 3}], exposure="X", outcome="Y")
    spots = Q.node_places("ZWXY", Q.node_times(reg), ("X", "Y"))
    assert spots == {"Z": (-1.0, -0.75), "W": (-1.0, 0.75), "X": (0.0, 0.0), "Y": (1.0, 0.0)}
    assert Q.node_times(R.build([{"name": "X3"}, {"name": "X1"}])) == {"X3": 3, "X1": 1} and Q.node_times(R.build([{"name": "A"}, {"name": "X1"}])) == {"A": 1, "X1": 1}
    rows = [{"model_id": "M", "comp_id": r["comp_id"], "status": "present" if r["type"] == "node" else ("causal", "unknown", "non-causal")[i % 3]} for i, r in enumerate(reg.rows)]
    claims = R.claims_frame(spark, rows)
    e = Q.model_edges(claims, reg, ("X", "Y")).collect()
    assert {r["line"] for r in e} == {"solid", "dashed"} and all(r["status"] != "non-causal" for r in e) and Q.model_nodes(claims, reg).count() == 4
    assert Q.adjustment_labels(claims, reg, "X", "Y").first()["label"].startswith("Adjust for: ")
