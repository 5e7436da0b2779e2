"""Causal profiles: minimal adjustment sets, identifiability and relevant nodes of each model's graph for one effect.

Graphs are small and many models share one, so distinct signatures are reasoned on once, in Arrow batches, and joined back.
Three values are told apart: a null (unavailable, with the reason), no set at all, and the empty set.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.errors import CausalError
from causeway.functions import bits
from causeway.functions import graphs as G
from causeway.operators import models as M
from causeway.operators import signatures as S
from causeway.sources.registry import Registry

RESOLVED = "sig string, mas array<array<string>>, identified boolean, formula string, method string, nodes array<string>, reason string"


def _reason(registry: Registry, exposure: str, outcome: str, criterion: str):
    """A function from a packed model to (mas, identified, formula, method, nodes, reason)."""
    names = [r["source"] for r in registry.nodes]
    node_bit = [registry.ordinal[r["comp_id"]] for r in registry.nodes]
    at = {s: i for i, s in enumerate(names)}
    x, y = at[exposure], at[outcome]
    edges = [(registry.ordinal[r["comp_id"]], at[r["source"]], at[r["target"]], r["direction"]) for r in registry.edges]
    hidden = sum(1 << i for i, r in enumerate(registry.nodes) if not r["observed"])
    check = S.Checker(registry)
    none = (None,) * 5

    def profile(present: int, causal: int, timing: list):
        here = sum(1 << i for i, b in enumerate(node_bit) if present >> b & 1)
        if not (here >> x & 1 and here >> y & 1):
            return *none, "exposure or outcome is absent"
        if not check.valid(causal, timing):
            return *none, "the model is not valid"
        g = G.Graph(len(names))
        for b, s, t, arrow in edges:
            if causal >> b & 1:
                (g.directed if arrow == "->" else g.bidirected).add((s, t))
        try:
            seen = G.project(g, hidden & here)
        except ValueError as e:
            return *none, str(e)
        sets = G.adjustment_sets(seen, x, y, here & ~hidden, criterion)
        mas = sorted((sorted(names[i] for i in G.bits_of(z)) for z in sets), key=lambda z: (len(z), z))
        nodes = sorted(names[i] for i in G.bits_of(here & ~G.between(g, x, y)))
        return mas, *G.effect(seen, x, y, here & ~hidden, sets if criterion == "back-door" else G.adjustment_sets(seen, x, y, here & ~hidden), names), nodes, None

    return profile


def of_signatures(models: DataFrame, registry: Registry, exposure: str, outcome: str, criterion: str = "back-door") -> DataFrame:
    """One row for each distinct signature of these (resolved) models."""
    n, profile = registry.words, _reason(registry, exposure, outcome, criterion)
    one = models.select(M.signature(registry).alias("sig"), *(f"{k}{i}" for k in ("np", "cm") for i in range(n)), "timing").dropDuplicates(["sig"])

    def run(batches):
        for b in batches:
            cols = b.to_pydict()
            rows = [profile(S.to_int([cols[f"np{i}"][r] for i in range(n)]), S.to_int([cols[f"cm{i}"][r] for i in range(n)]), cols["timing"][r]) for r in range(len(b))]
            text = pa.list_(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(cols["sig"], pa.string()), pa.array([r[0] for r in rows], text), pa.array([r[1] for r in rows], pa.bool_()), *(pa.array([r[i] for r in rows], pa.string()) for i in (2, 3)), pa.array([r[4] for r in rows], pa.list_(pa.string())), pa.array([r[5] for r in rows], pa.string())], ["sig", "mas", "identified", "formula", "method", "nodes", "reason"])

    return one.mapInArrow(run, RESOLVED)


def build(models: DataFrame, registry: Registry, exposure: str, outcome: str, criterion: str = "back-door") -> DataFrame:
    """(model_id, is_resolved, mas, robust_mas, identified, formula, method, nodes, completion_count, coverage_complete, reason) of every model.

    A partial model's robust sets are those of all its completions, its nodes those of any, its identification false if one's is; it has no
    formula. ``criterion``: of adjustment sets, back-door or total (``graphs.adjustment_sets``).
    """
    if exposure not in registry.node_id or outcome not in registry.node_id or exposure == outcome:
        raise CausalError("exposure and outcome must be two nodes of the registry", "INVALID_CAUSAL_TARGET")
    sig = M.signature(registry)
    done = S.resolved(models, registry).select("model_id", sig.alias("sig")).join(of_signatures(S.resolved(models, registry), registry, exposure, outcome, criterion), "sig", "left")
    whole = done.select("model_id", F.lit(True).alias("is_resolved"), "mas", F.col("mas").alias("robust_mas"), "identified", "formula", "method", "nodes", F.lit(1).cast("bigint").alias("completion_count"), F.col("reason").isNull().alias("coverage_complete"), "reason")
    partial = models.where(bits.any_set(M.unknown(registry)))
    m = S.matched(partial, registry, models).join(done.select(F.col("model_id").alias("descendant"), "mas", "identified", "nodes"), "descendant", "left")
    each = m.groupBy("model_id").agg(F.count("descendant").alias("n"), F.count("*").alias("expected"), F.count("mas").alias("with_mas"), F.bool_and("identified").alias("all_true"), F.count("identified").alias("with_id"), F.count("nodes").alias("with_nodes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("nodes")))).alias("nodes"))
    sets = m.select("model_id", F.explode("mas").alias("z")).groupBy("model_id", "z").agg(F.count("*").alias("k"))
    kept = sets.join(each.select("model_id", "n"), "model_id").where("k = n").groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct(F.size("z").alias("len"), "z"))).alias("r"))
    p = partial.select("model_id").join(each, "model_id", "left").join(kept, "model_id", "left")
    n, expected = F.coalesce("n", F.lit(0)), F.coalesce("expected", F.lit(0))
    covered = n == expected
    none = F.array().cast("array<array<string>>")
    robust = F.when(covered & (F.coalesce("with_mas", F.lit(0)) == n), F.coalesce(F.transform("r", lambda q: q["z"]), none))
    known = F.when(~F.coalesce("all_true", F.lit(True)), False).when(covered & (n > 0) & (F.col("with_id") == n), True)
    part = p.select("model_id", F.lit(False).alias("is_resolved"), F.lit(None).cast("array<array<string>>").alias("mas"), robust.alias("robust_mas"), known.alias("identified"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("string").alias("method"), F.when(covered & (n > 0) & (F.col("with_nodes") == n), F.col("nodes")).alias("nodes"), n.alias("completion_count"), covered.alias("coverage_complete"), F.when(~covered, "completions are missing").alias("reason"))
    return whole.unionByName(part)


def cyclic(models: DataFrame, registry: Registry) -> DataFrame:
    """(model_id) of packed models whose causal directed edges run in a circle."""
    check, n = S.Checker(registry), registry.words

    def run(batches):
        for x in batches:
            cols = x.to_pydict()
            bad = []
            for r, name in enumerate(cols["model_id"]):
                causal = S.to_int([cols[f"cm{i}"][r] for i in range(n)])
                if not G.Graph(check.n, {(s, t) for b, s, t in check.directed if causal >> b & 1}).acyclic():
                    bad.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["model_id"])

    return models.select("model_id", *(f"cm{i}" for i in range(n))).mapInArrow(run, "model_id string")


def mas_compatible(a: Column, b: Column) -> Column:
    """Null if either is; false if either has no set; else whether they share one."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when((F.size(a) == 0) | (F.size(b) == 0), False).otherwise(F.arrays_overlap(a, b))


def identified_compatible(ia: Column, ib: Column, na: Column, nb: Column) -> Column:
    """Null if either is; false if either isn't identified; null without both node sets; else whether they are equal."""
    return F.when(ia.isNull() | ib.isNull(), F.lit(None).cast("boolean")).when(~ia | ~ib, False).when(na.isNull() | nb.isNull(), F.lit(None).cast("boolean")).otherwise(na == nb)


def compare(dyads: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pairs (ego_id, alter_id) with both sides' profiles and the two causal metrics."""
    cut = ["robust_mas", "identified", "nodes"]
    e = profiles.select(F.col("model_id").alias("ego_id"), *(F.col(c).alias(f"{c}_ego") for c in cut))
    a = profiles.select(F.col("model_id").alias("alter_id"), *(F.col(c).alias(f"{c}_alter") for c in cut))
    c = F.col
    out = dyads.join(e, "ego_id", "left").join(a, "alter_id", "left")
    return out.withColumns({"mas_compatible": mas_compatible(c("robust_mas_ego"), c("robust_mas_alter")), "identified_compatible": identified_compatible(c("identified_ego"), c("identified_alter"), c("nodes_ego"), c("nodes_alter"))}).withColumnsRenamed({"robust_mas_ego": "mas_ego", "robust_mas_alter": "mas_alter", "nodes_ego": "identification_nodes_ego", "nodes_alter": "identification_nodes_alter"})
