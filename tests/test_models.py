"""Golden values of the three-node example, and graphs against exhaustive search."""

from collections import Counter
from fractions import Fraction
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from causeway.errors import ExpansionError, RegistryError, StateError
from causeway.functions import graphs as G
from causeway.operators import dyads as D
from causeway.operators import expansion as X
from causeway.operators import models as M
from causeway.operators import profiles as P
from causeway.operators import signatures as S
from causeway.sources import registry as R

NODES = [{"name": "Z", "timing": 1}, {"name": "X", "timing": 2}, {"name": "Y", "timing": 3}]


@pytest.fixture(scope="module")
def f2(spark):
    reg = R.build(NODES, exposure="X", outcome="Y")
    claims = X.exhaustive(spark, reg).persist()
    return reg, claims, M.pack(claims, reg).persist()


def test_registry_and_states(f2):
    reg, claims, _ = f2
    assert [(r["comp_id"], r["source"], r["target"], r["fixed_status"]) for r in reg.rows] == [("C0001", "Z", None, None), ("C0002", "X", None, None), ("C0003", "Y", None, None), ("C0004", "Z", "X", None), ("C0005", "Z", "Y", None), ("C0006", "X", "Y", "causal")]
    rows = {(r["model_id"], r["comp_id"]): r["status"][0] for r in claims.collect()}
    assert len(rows) == 54
    assert ["".join(rows[f"M{i:04d}", c] for c in ("C0004", "C0005")) for i in range(1, 10)] == ["cc", "cu", "cn", "uc", "uu", "un", "nc", "nu", "nn"]


def test_pairs(f2):
    reg, _, m = f2
    rows = {r["dyad_id"]: r for r in D.all_pairs(m, reg).collect()}
    assert len(rows) == 72
    rate = Counter(Fraction(r["shared_resolved_claims"], r["union_resolved_claims"]) for r in rows.values())
    assert rate == {Fraction(5, 6): 16, Fraction(4, 5): 8, Fraction(5, 7): 8, Fraction(2, 3): 20, Fraction(4, 7): 16, Fraction(1, 2): 4}
    r = rows["M0001__M0009"]
    assert (r["shared_resolved_claims"], r["union_resolved_claims"], r["repair_cost"], r["similarity_rate"], r["conflicting_components"]) == (4, 8, 2, 0.5, ["C0004", "C0005"])
    assert rows["M0002__M0004"]["similarity_rate"] == 0.666667 and not rows["M0002__M0004"]["existence_conflict"]
    assert all(r["timing_compatible"] for r in rows.values())
    some = D.touching(m, reg, m.where("model_id = 'M0003'").select("model_id"))
    assert sorted(r["dyad_id"] for r in some.collect()) == sorted(k for k in rows if "M0003" in k)
    assert {r["ego_id"] for r in D.single_reference(m, reg, "M0005").collect()} == {"M0005"}
    assert D.counts(D.pairs(m, reg, itself=True), reg).where("ego_id = alter_id and shared = union_claims").count() == 9


def test_profiles(f2):
    reg, _, m = f2
    p = {r["model_id"]: r for r in P.build(m, reg, "X", "Y").collect()}
    assert p["M0001"]["mas"] == [["Z"]] and all(p[f"M000{i}"]["mas"] == [[]] for i in (3, 7, 9))
    assert p["M0006"]["robust_mas"] == p["M0008"]["robust_mas"] == [[]]
    assert all(p[f"M000{i}"]["robust_mas"] == [] and p[f"M000{i}"]["mas"] is None for i in (2, 4, 5))
    assert all(r["identified"] and r["nodes"] == ["X", "Y", "Z"] for r in p.values())
    c = P.compare(D.counts(D.pairs(m, reg), reg).select("ego_id", "alter_id"), P.build(m, reg, "X", "Y"))
    assert c.where("mas_compatible").count() == 20 and c.where("identified_compatible").count() == 72
    d = {r["model_id"]: r for r in S.diagnostics(m, reg).collect()}
    assert d["M0005"]["expected"] == d["M0005"]["represented"] == 4 and all(r["coverage_complete"] for r in d.values())
    assert S.support(m.where("model_id <> 'M0009'"), reg).select("model_id").collect()[0][0] == "__support_000001"


def test_claims_round_trip_and_are_checked(spark, f2):
    reg, claims, m = f2
    back = M.unpack(m, reg)
    assert sorted(map(tuple, back.select("model_id", "comp_id", "status").collect())) == sorted(map(tuple, claims.select("model_id", "comp_id", "status").collect()))
    assert M.unpack(m, reg, dense=True).count() == 54 and M.unknown_edges(m, reg).count() == 6
    bad = R.claims_frame(spark, [{"model_id": "A", "comp_id": "C0001", "status": "absent"}, {"model_id": "A", "comp_id": "C0004", "status": "causal"}])
    with pytest.raises(StateError, match="endpoint"):
        M.require_valid(bad, reg)
    assert M.pack(bad, reg).first()["cm0"] == 0
    changed = M.set_status(claims, spark.createDataFrame([("M0001", "C0004", "unknown")], "model_id string, comp_id string, status string"))
    assert M.unknown_edges(M.pack(changed, reg), reg).count() == 7 and changed.count() == 54


def test_registry_rules(spark, tmp_path):
    with pytest.raises(RegistryError):
        R.build(NODES, exposure="X")
    with pytest.raises(RegistryError):
        R.build(NODES, exposure="X", outcome="Y", constraints=[{"source": "X", "target": "Y", "direction": "->", "rule": "forbid"}])
    untimed = R.build([{"name": n} for n in "XYZ"], exposure="X", outcome="Y", include_bidirectional=True)
    edges = {(r["source"], r["target"], r["direction"]) for r in untimed.edges}
    assert ("Y", "X", "->") not in edges and ("X", "Y", "<->") not in edges and ("X", "Z", "<->") in edges and len(edges) == 7
    late = R.build([{"name": "A", "timing_options": [1, 3]}, {"name": "B", "timing_options": [2]}], constraints=[{"source": "A", "target": "B", "direction": "<->", "rule": "require"}])
    assert [(r["source"], r["target"], r["direction"]) for r in late.edges] == [("A", "B", "->"), ("B", "A", "->"), ("A", "B", "<->")]
    last = R.build(NODES, constraints=[{"source": "Z", "target": "X", "direction": "->", "rule": "allow"}, {"source": "X", "target": "Y", "direction": "->", "rule": "require"}])
    assert [(r["source"], r["target"]) for r in last.edges] == [("Z", "X"), ("X", "Y")] and last.rows[-1]["description"].endswith("(required)")
    late.write(spark, str(tmp_path / "r"))
    assert R.read(spark, str(tmp_path / "r")).rows == late.rows and R.read(spark, str(tmp_path / "r")).meta["timing_options"] == {"A": [1, 3], "B": [2]}
    with pytest.raises(RegistryError):
        R.from_rows([])


def test_expansion_limits_cycles_and_samples(spark):
    reg = R.build([{"name": n} for n in "ABC"])
    with pytest.raises(ExpansionError):
        X.exhaustive(spark, reg, max_models=100)
    ids = X.exhaustive(spark, reg, edge_statuses=("causal", "non-causal")).select("model_id").distinct()
    assert ids.count() == 25  # labelled acyclic graphs on three nodes
    one = sorted(map(tuple, X.sampled(spark, reg, 10, seed=5).collect()))
    assert one == sorted(map(tuple, X.sampled(spark, reg, 10, seed=5).collect())) and len({r[0] for r in one}) == 10
    some = X.exhaustive(spark, R.build(NODES, exposure="X", outcome="Y"), node_policy="optional", required_nodes=["X", "Y"])
    assert some.select("model_id").distinct().count() == 10


def test_seeds(spark, f2):
    reg, claims, _ = f2
    seed = R.claims_frame(spark, [{"model_id": "S1", "comp_id": c, "status": "causal"} for c in ("C0004", "C0005", "C0006")])
    out = X.with_seeds(claims, seed, reg)
    ids = {r[0] for r in out.select("model_id").distinct().collect()}
    assert "S1" in ids and "M0001" not in ids and len(ids) == 9


def test_graphs_by_brute_force():
    def paths_open(g, x, y, z):
        """d-connection by walking all simple paths."""
        edges = g.directed
        below = {i: set(G.bits_of(G.reach(1 << i, g.children()))) for i in range(g.n)}

        def walk(path):
            last = path[-1]
            if last == y:
                for a, b, c in zip(path, path[1:], path[2:], strict=False):
                    collider = (a, b) in edges and (c, b) in edges
                    if collider and not below[b] & set(z) or not collider and b in z:
                        return False
                return True
            return any(walk([*path, n]) for n in range(g.n) if n not in path and ((last, n) in edges or (n, last) in edges))

        return walk([x])

    for on in product((0, 1), repeat=6):
        g = G.Graph(4, {e for e, k in zip(combinations(range(4), 2), on, strict=True) if k})
        for zs in ((), (1,), (2,), (1, 2)):
            assert G.separated(g, 0, 3, sum(1 << i for i in zs)) == (not paths_open(g, 0, 3, zs)), (on, zs)


def test_front_door_and_bow():
    names = {n: i for i, n in enumerate(("X1", "X2", "Y", "U"))}
    hidden = {(names["U"], names["X1"]), (names["U"], names["Y"]), (names["X1"], names["X2"]), (names["X2"], names["Y"])}
    for direct, known in ((False, True), (True, False)):
        g = G.project(G.Graph(4, hidden | ({(0, 2)} if direct else set())), 1 << 3)
        assert g.bidirected == {(0, 2)} and G.adjustment_sets(g, 0, 2, 0b111) == []
        assert G.identifiable(g, 1, 4, 0b111) is known
    assert G.adjustment_sets(G.Graph(3, {(0, 1), (1, 2)}), 0, 2, 0b111) == [0]


def test_symmetry_and_identity(spark, f2):
    reg, _, m = f2
    c = D.counts(D.pairs(m, reg), reg)
    back = c.select(F.col("ego_id").alias("alter_id"), F.col("alter_id").alias("ego_id"), "shared", "union_claims", "repair_cost")
    assert c.select(*back.columns).exceptAll(back).count() == 0
    assert c.where("repair_cost = 0").count() == 0


def test_samples_of_spaces_of_any_size(spark):
    reg = R.build([{"name": f"N{i}"} for i in range(12)], exposure="N0", outcome="N1")
    p = X.plan(reg)
    assert p.projected > 2**200
    got = X.sampled(spark, reg, 8, seed=3, edge_statuses=("causal", "non-causal", "unknown"))
    again = X.sampled(spark, reg, 8, seed=3, edge_statuses=("causal", "non-causal", "unknown"))
    assert got.exceptAll(again).count() == 0 == got.count()  # no draw of so dense a space is acyclic
    timed = R.build([{"name": f"N{i}", "timing": i} for i in range(13)])
    assert X.plan(timed).projected == 3**78 and X.sampled(spark, timed, 8, seed=3).select("model_id").distinct().count() == 8
    few = R.build([{"name": n, "timing": i} for i, n in enumerate("ABCDEF")])
    e = X.expand(spark, few, n_models=300, seed=1)
    assert e.report["generated"] == 300 and e.report["projected"] == 3**15 and e.report["pruned_cycles"] == 0
    share = {(r["comp_id"], r["status"]): r["count"] for r in e.claims.groupBy("comp_id", "status").count().collect()}
    assert all(60 < share[c["comp_id"], s] < 140 for c in few.edges for s in ("causal", "unknown", "non-causal"))
    ids = [r[0] for r in e.claims.select("model_id").distinct().orderBy("model_id").collect()]
    assert ids == [f"M{i:04d}" for i in range(1, 301)]


def test_sampled_models_are_those_of_their_numbers(spark):
    """A sample of all is all, in the same order and under the same names."""
    reg = R.build([{"name": n} for n in "AB"])
    whole = X.exhaustive(spark, reg)
    assert X.sampled(spark, reg, whole.select("model_id").distinct().count(), seed=2).exceptAll(whole).count() == 0


def test_report_counts_what_is_left_out(spark):
    reg = R.build([{"name": n} for n in "ABC"])
    e = X.expand(spark, reg, "exhaustive", edge_statuses=("causal", "non-causal"))
    assert (e.report["projected"], e.report["generated"], e.report["pruned_cycles"], e.report["node_subsets"]) == (64, 25, 39, 1)
    with pytest.raises(ExpansionError):
        X.expand(spark, reg, "other")


def test_a_seed_takes_one_models_place(spark, f2):
    reg, claims, _ = f2
    twice = claims.union(claims.where("model_id = 'M0001'").withColumn("model_id", F.lit("M0099")))
    seeds = R.claims_frame(spark, [{"model_id": m, "comp_id": c, "status": "causal"} for m in ("M0004", "S1") for c in ("C0004", "C0005", "C0006")][:3])
    out = X.with_seeds(twice, seeds, reg)
    ids = sorted(r[0] for r in out.select("model_id").distinct().collect())
    # one twin is left, and numbers skip the seed's id
    assert len(ids) == 10 and ids == ["M0002", "M0003", "M0004"] + [f"M{i:04d}" for i in range(5, 12)]
    assert {r[0] for r in out.where("seeded").select("model_id").distinct().collect()} == {"M0004"}
    late = R.claims_frame(spark, [{"model_id": "S", "comp_id": "C0001", "status": "present", "timing": 9}, {"model_id": "S", "comp_id": "C0006", "status": "causal"}])
    with pytest.raises(ExpansionError, match="time"):
        X.with_seeds(claims, late, reg)


def test_separators_and_adjustment_by_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(150):
        n = 6
        g = G.Graph(n, {(a, b) for a, b in combinations(range(n), 2) if rng.random() < 0.4}, {(a, b) for a, b in combinations(range(n), 2) if rng.random() < 0.1})
        x, y = 1, 5
        for criterion in ("back-door", "total"):
            few = G.adjustment_sets(g, x, y, (1 << n) - 1, criterion)
            was, G.MOST_CANDIDATES = G.MOST_CANDIDATES, -1
            try:
                assert sorted(G.adjustment_sets(g, x, y, (1 << n) - 1, criterion)) == sorted(few)
            finally:
                G.MOST_CANDIDATES = was
    chain = G.Graph(16, {(0, 14), (0, 15), (14, 15), *((i, 14) for i in range(1, 14)), *((i, 15) for i in range(1, 14))})
    assert G.adjustment_sets(chain, 14, 15, (1 << 16) - 1) == [(1 << 14) - 1]
    # a node that the effect doesn't run through may be adjusted for though it is below the exposure
    side = G.Graph(4, {(0, 1), (0, 2), (3, 2), (3, 1)})
    assert G.adjustment_sets(side, 0, 1, 0b1111) == [0] == G.adjustment_sets(side, 0, 1, 0b1111, "total")


def test_identified_effects_are_right_in_numbers():
    """Formulas evaluated on the observed law of random structural models against the law under intervention."""
    import numpy as np

    rng = np.random.default_rng(2)

    def law(g, do=None):
        """Joint law of binary nodes: every node by its parents and its latent causes."""
        full = G.with_latents(g)
        out = {}
        for v in product((0, 1), repeat=full.n):
            p = 1.0
            for i in range(full.n):
                own = tuple(v[a] for a in G.bits_of(full.parents()[i]))
                q = tables.setdefault((i, own), rng.uniform(0.1, 0.9))
                p *= (v[i] == do[i]) if do and i in do else q if v[i] else 1 - q
            out[v[: g.n]] = out.get(v[: g.n], 0) + p
        return out

    def value(e, at, joint):
        if e[0] == "p":
            pick = lambda nodes: sum(p for v, p in joint.items() if all(v[i] == at[i] for i in G.bits_of(nodes)))
            return pick(e[1] | e[2]) / (pick(e[2]) if e[2] else 1)
        if e[0] == "sum":
            nodes = G.bits_of(e[1])
            return sum(value(e[2], {**at, **dict(zip(nodes, v, strict=True))}, joint) for v in product((0, 1), repeat=len(nodes)))
        parts = [value(p, at, joint) for p in e[1:]]
        return float(np.prod(parts)) if e[0] == "product" else parts[0] / parts[1]

    general = 0
    graphs = [G.Graph(3, {(0, 1), (1, 2)}, {(0, 2)}), G.Graph(4, {(0, 1), (1, 2), (2, 3)}, {(0, 2), (0, 3), (1, 3)})]
    while len(graphs) < 40:
        graphs.append(G.Graph(4, {e for e in combinations(range(4), 2) if rng.random() < 0.6}, {e for e in combinations(range(4), 2) if rng.random() < 0.25}))
    for g in graphs:
        tables = {}
        joint = law(g)
        y = g.n - 1
        e = G.identify(g, 1, 1 << y)
        assert (e is not None) == G.identifiable(g, 1, 1 << y)
        if e is None:
            continue
        general += not G.adjustment_sets(g, 0, y, (1 << g.n) - 1)
        for a, b in product((0, 1), repeat=2):
            truth = sum(p for v, p in law(g, {0: a}).items() if v[y] == b)
            free = {i: 0 for i in range(g.n)}  # what the formula doesn't depend on
            assert abs(value(e, free | {0: a, y: b}, joint) - truth) < 1e-9
    assert general >= 2
    front = G.Graph(3, {(0, 1), (1, 2)}, {(0, 2)})
    assert G.effect(front, 0, 2, 0b111, [], ["X", "M", "Y"])[1:] == ("P(Y | do(X)) = sum_{M} P(M | X) [sum_{X} P(X) P(Y | X, M)]", "general")


def test_formulas_in_profiles(f2):
    reg, _, m = f2
    p = {r["model_id"]: r for r in P.build(m, reg, "X", "Y").collect()}
    assert p["M0001"]["formula"] == "P(Y | do(X)) = sum_{Z} P(Y | X, Z) P(Z)" and p["M0001"]["method"] == "back-door"
    assert p["M0009"]["formula"] == "P(Y | do(X)) = P(Y | X)" and p["M0002"]["formula"] is None


def test_states_are_made_and_changed(spark, f2):
    reg, claims, _ = f2
    made = M.create(spark.createDataFrame([("A",), ("B",), ("A",)], "model_id string"), reg)
    assert made.count() == 12 and M.pack(made, reg).first()["np0"] == 0
    change = lambda *rows: spark.createDataFrame(rows, "model_id string, comp_id string, status string")
    for bad in (("M0099", "C0004", "causal"), ("M0001", "C0099", "causal"), ("M0001", "C0004", "present")):
        with pytest.raises(StateError):
            M.set_status(claims, change(bad), reg)
    with pytest.raises(StateError, match="twice"):
        M.set_status(claims, change(("M0001", "C0004", "causal"), ("M0001", "C0004", "unknown")), reg)
    timed = M.set_timing(claims, spark.createDataFrame([("M0001", "C0001", 7)], "model_id string, comp_id string, timing int"), reg)
    assert timed.where("model_id = 'M0001' and comp_id = 'C0001'").first()["timing"] == 7 and timed.count() == claims.count()
    with pytest.raises(StateError):
        M.set_timing(claims, spark.createDataFrame([("M0001", "C0004", 7)], "model_id string, comp_id string, timing int"), reg)


def test_example_data(spark, tmp_path):
    from causeway.sources import seed

    reg = seed.registry()
    assert reg.summary() == {"total": 28, "nodes": 16, "edges": 12, "directed": 8, "bidirected": 4}
    seed.write(spark, str(tmp_path))
    assert R.read(spark, str(tmp_path / "registry")).rows == reg.rows
    claims = spark.read.parquet(str(tmp_path / "claims"))
    assert claims.count() == 43 and claims.select("model_id").distinct().count() == 7
    assert M.unpack(M.pack(claims, reg), reg).where("model_id = 'M0005' and status = 'present'").count() == 3


def test_interview():
    answers = {"Variables": "Z, X, Y, W", "Exposure": "X", "Outcome": "Y", "Time of Z": "1", "Time of X": "2", "Time of Y": "4", "Time of W": "1, 3", "Required edges": "(Z,X)", "Possible": "(Z,Y)", "Variables that": "W"}
    ask = lambda prompt: next((a for k, a in sorted(answers.items(), key=lambda x: -len(x[0])) if prompt.startswith(k)), "")
    reg, options = R.interview(ask)
    assert reg.meta["exposure"] == "X" and options["timing_options"]["W"] == [1, 3] and options["required_nodes"] == ["Z", "X", "Y"]
    assert next(r for r in reg.edges if (r["source"], r["target"]) == ("Z", "X"))["fixed_status"] == "causal"
    assert X.plan(reg, **options).report["node_subsets"] == 2
    answers["Time of X"] = "1, 2"
    with pytest.raises(RegistryError):
        R.interview(ask)
