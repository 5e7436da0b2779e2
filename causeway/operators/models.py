"""Claims and packed models.

Claims are long: (model_id, comp_id, status, timing). A packed model is one row: sets of present nodes (``np``), applicable edges
(``app``), edges claimed causal (``cm``) and non-causal (``xm``, both within ``app``), and its nodes' timings by ordinal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.errors import StateError
from causeway.functions import bits
from causeway.sources.registry import Registry

#: Accepted statuses and what they mean: node presence, and the two resolved edge statuses. ``unknown`` is the absence of both.
NODE = {"present": True, "causal": True, "absent": False, "unknown": False, "non-causal": False}
DIRECTED = {"causal": "causal", "non-causal": "non-causal", "unknown": "unknown"}
BIDIRECTED = DIRECTED | {"present": "causal", "absent": "non-causal"}


def _lookup(registry: Registry) -> list[tuple]:
    out = []
    for r in registry.rows:
        s, t = (registry.ordinal[x] for x in registry.ends(r["comp_id"])) if r["type"] == "edge" else (None, None)
        out.append((r["comp_id"], registry.ordinal[r["comp_id"]], r["type"], r["direction"], s, t))
    return out


def annotated(claims: DataFrame, registry: Registry) -> DataFrame:
    """Claims with each component's ordinal, kind and ends. The registry is broadcast: it is as small as the driver's list."""
    reg = claims.sparkSession.createDataFrame(_lookup(registry), "comp_id string, ord int, kind string, direction string, s int, t int")
    return claims.join(F.broadcast(reg), "comp_id", "left")


def invalid(claims: DataFrame, registry: Registry) -> DataFrame:
    """Claims that are not valid, with the reason."""
    c = annotated(claims, registry)
    status = F.col("status")
    why = (
        F.when(F.col("ord").isNull(), "unknown component")
        .when((F.col("kind") == "node") & ~status.isin(*NODE), "not a node status")
        .when((F.col("direction") == "->") & ~status.isin(*DIRECTED), "not an edge status")
        .when((F.col("direction") == "<->") & ~status.isin(*BIDIRECTED), "not an edge status")
    )
    gone = c.where((F.col("kind") == "node") & ~_present()).select("model_id", F.col("ord").alias("gone"))
    edges = c.where("kind = 'edge'").alias("e").join(gone.alias("g"), (F.col("e.model_id") == F.col("g.model_id")) & ((F.col("e.s") == F.col("g.gone")) | (F.col("e.t") == F.col("g.gone"))), "left_semi")
    return c.withColumn("why", why).where("why is not null").select("model_id", "comp_id", "status", "why").union(edges.select("model_id", "comp_id", "status", F.lit("an endpoint is claimed absent")))


def require_valid(claims: DataFrame, registry: Registry) -> DataFrame:
    if bad := invalid(claims, registry).first():
        raise StateError(f"{bad['model_id']}, {bad['comp_id']}: {bad['why']} ({bad['status']})")
    return claims


def _present() -> Column:
    return F.col("status").isin(*(s for s, on in NODE.items() if on))


def applicable(registry: Registry, nodes: list[Column]) -> list[Column]:
    """The set of edges whose ends are both in a set of nodes."""
    out: list[list[Column]] = [[] for _ in range(registry.words)]
    for r in registry.edges:
        b = registry.ordinal[r["comp_id"]]
        s, t = (registry.ordinal[x] for x in registry.ends(r["comp_id"]))
        on = bits.has(nodes, s) & bits.has(nodes, t)
        out[b >> 6].append(F.when(on, F.lit(bits.signed(1 << (b & 63)))).otherwise(F.lit(0)).cast("bigint"))
    return [reduce(lambda x, y: x.bitwiseOR(y), w) if w else F.lit(0).cast("bigint") for w in out]


def pack(claims: DataFrame, registry: Registry, timed: bool = True) -> DataFrame:
    """One row per model. Edges without a claim are unknown, nodes without one absent; claims on inapplicable edges drop out."""
    n = registry.words
    c = annotated(claims, registry).where("ord is not null")
    node, edge = F.col("kind") == "node", F.col("kind") == "edge"
    causal = edge & (F.col("status").isin("causal", "present"))
    non = edge & ((F.col("status") == "non-causal") | ((F.col("direction") == "<->") & (F.col("status") == "absent")))
    aggs = []
    for name, when in (("np", node & _present()), ("_c", causal), ("_x", non)):
        aggs += [w.alias(f"{name}{i}") for i, w in enumerate(bits.union_of(F.col("ord"), F.lit(1), n, when))]
    times = F.map_from_entries(F.collect_list(F.when(node & F.col("timing").isNotNull(), F.struct("ord", "timing"))))
    m = c.groupBy("model_id").agg(*aggs, (times if timed else F.create_map().cast("map<int,int>")).alias("_t"))
    m = m.select("*", *(w.alias(f"app{i}") for i, w in enumerate(applicable(registry, bits.words("np", n)))))
    timing = F.array(*(F.try_element_at("_t", F.lit(registry.ordinal[r["comp_id"]])) for r in registry.nodes)).cast("array<int>")
    keep = [F.col(f"_{a}{i}").bitwiseAND(F.col(f"app{i}")).alias(f"{a}m{i}") for a in "cx" for i in range(n)]
    return m.select("model_id", *(f"np{i}" for i in range(n)), *(f"app{i}" for i in range(n)), *keep, timing.alias("timing"))


def unpack(models: DataFrame, registry: Registry, dense: bool = False) -> DataFrame:
    """Claims of packed models: present nodes and applicable edges, or with ``dense`` every component (null where an edge is inapplicable).

    Bidirected edges are present or absent.
    """
    n = registry.words
    node_at = {r["comp_id"]: i for i, r in enumerate(registry.nodes)}
    rows = []
    for r in registry.rows:
        b = registry.ordinal[r["comp_id"]]
        if r["type"] == "node":
            status = F.when(bits.has(bits.words("np", n), b), "present").otherwise(F.lit("absent") if dense else F.lit(None))
            time = F.get("timing", F.lit(node_at[r["comp_id"]]))
        else:
            yes, no, none = ("causal", "non-causal", "unknown") if r["direction"] == "->" else ("present", "absent", "absent")
            status = F.when(bits.has(bits.words("app", n), b), F.when(bits.has(bits.words("cm", n), b), yes).when(bits.has(bits.words("xm", n), b), no).otherwise(none))
            time = F.lit(None).cast("int")
        rows.append(F.struct(F.lit(r["comp_id"]).alias("comp_id"), status.alias("status"), time.alias("timing")))
    out = models.select("model_id", F.explode(F.array(*rows)).alias("r")).select("model_id", "r.*")
    return out if dense else out.where("status is not null")


def codes(claims: DataFrame) -> DataFrame:
    """The sparse matrix: 1 causal or present, 2 non-causal, 0 else."""
    return claims.select("model_id", "comp_id", F.when(F.col("status").isin("causal", "present"), 1).when(F.col("status") == "non-causal", 2).otherwise(0).alias("code"))


def set_status(claims: DataFrame, changes: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Claims with those of ``changes`` (model_id, comp_id, status) in place of theirs; with a registry, changes of unknown models or components or to a status that isn't one raise."""
    if registry is not None:
        if lost := changes.join(claims.select("model_id").distinct(), "model_id", "left_anti").first():
            raise StateError(f"no model {lost['model_id']}")
        if bad := invalid(changes, registry).where(~F.col("why").startswith("an endpoint")).first():
            raise StateError(f"{bad['model_id']}, {bad['comp_id']}: {bad['why']} ({bad['status']})")
        if twice := changes.groupBy("model_id", "comp_id").count().where("count > 1").first():
            raise StateError(f"{twice['model_id']}, {twice['comp_id']} is changed twice")
    kept = claims.join(changes.select("model_id", "comp_id"), ["model_id", "comp_id"], "left_anti")
    times = claims.select("model_id", "comp_id", "timing")
    return kept.unionByName(changes.join(times, ["model_id", "comp_id"], "left").select("model_id", "comp_id", "status", "timing"))


def set_timing(claims: DataFrame, changes: DataFrame, registry: Registry) -> DataFrame:
    """Claims with the times of ``changes`` (model_id, comp_id, timing) for the nodes that the models hold present."""
    nodes = [r["comp_id"] for r in registry.nodes]
    if bad := changes.where(~F.col("comp_id").isin(nodes)).first():
        raise StateError(f"{bad['comp_id']} is no node, so it has no time")
    if lost := changes.join(claims, ["model_id", "comp_id"], "left_anti").first():
        raise StateError(f"{lost['model_id']} claims nothing of {lost['comp_id']}")
    new = changes.select("model_id", "comp_id", F.col("timing").cast("int").alias("_t"), F.lit(True).alias("_set"))
    return claims.join(new, ["model_id", "comp_id"], "left").select("model_id", "comp_id", "status", F.when(F.col("_set"), F.col("_t")).otherwise(F.col("timing")).alias("timing"))


def create(models: DataFrame, registry: Registry, status: str = "unknown") -> DataFrame:
    """Claims of ``status`` by each of ``models`` (model_id) on every component; nodes of unknown status are absent, as everywhere."""
    if status not in DIRECTED:
        raise StateError(f"{status} is no status of an edge")
    reg = models.sparkSession.createDataFrame([(r["comp_id"],) for r in registry.rows], "comp_id string")
    return models.select("model_id").distinct().crossJoin(F.broadcast(reg)).select("model_id", "comp_id", F.lit(status).alias("status"), F.lit(None).cast("int").alias("timing"))  # as small as the registry


def unknown(registry: Registry, side: str = "") -> list[Column]:
    """The set of applicable edges without a resolved claim."""
    n = registry.words
    return bits.each(lambda a, c, x: a.bitwiseAND(F.bitwise_not(c.bitwiseOR(x))), *(bits.words(k, n, side) for k in ("app", "cm", "xm")))


def unknown_edges(models: DataFrame, registry: Registry) -> DataFrame:
    """(model_id, comp_id) of every unknown applicable edge."""
    names = [(registry.ordinal[r["comp_id"]], r["comp_id"]) for r in registry.edges]
    return models.select("model_id", F.explode(bits.members(unknown(registry), names)).alias("comp_id"))


def backward_edges(registry: Registry, side: str = "") -> Column:
    """The set, as names, of causal directed edges whose source isn't earlier than its target though both times are known."""
    at = {r["source"]: i for i, r in enumerate(registry.nodes)}
    n, time = registry.words, F.col(f"{side}timing")
    rows = []
    for r in registry.edges:
        if r["direction"] == "->":
            late = F.get(time, F.lit(at[r["source"]])) >= F.get(time, F.lit(at[r["target"]]))
            rows.append(F.when(bits.has(bits.words("cm", n, side), registry.ordinal[r["comp_id"]]) & F.coalesce(late, F.lit(False)), F.lit(r["comp_id"])))
    return F.array_compact(F.array(*rows)) if rows else F.array().cast("array<string>")


def signature(registry: Registry) -> Column:
    """A digest of what a model claims: present nodes, statuses of applicable edges, timings."""
    n = registry.words
    return F.sha2(F.concat_ws("|", *(w.cast("string") for k in ("np", "cm", "xm") for w in bits.words(k, n)), F.to_json("timing")), 256)
