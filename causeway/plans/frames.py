"""The frames that plots of models and scenarios read: nodes in places, edges between them, and the bars, lines and tiles of each scenario."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.errors import ScenarioError
from causeway.operators import models as M
from causeway.operators import profiles as P
from causeway.operators import summaries as U
from causeway.plans.scenarios import Result
from causeway.sources.registry import Registry

#: Nodes of one time are so far apart.
APART = 1.5
LABEL = {"similarity_rate": "Structural similarity", "mas_compatible": "Shared adjustment set", "identified_compatible": "Identified alike"}


def node_times(registry: Registry) -> dict[str, int]:
    """Times of nodes: the registry's (1 where one is missing), or the numbers of names like X3, or 1 for all."""
    names = [r["source"] for r in registry.nodes]
    own = {n: t for n, t in (registry.meta.get("timing") or {}).items() if t is not None}
    if own:
        return {n: own.get(n, 1) for n in names}
    found = [re.fullmatch(r"X(\d+)", n) for n in names]
    return {n: int(m[1]) for n, m in zip(names, found, strict=True)} if all(found) else dict.fromkeys(names, 1)


def node_places(names: Iterable[str], times: dict[str, int], focal: Iterable[str] = ()) -> dict[str, tuple[float, float]]:
    """Places from left (-1, earliest) to right (1, latest). Focal nodes lie on the middle line, others are spread about it."""
    names, focal = list(names), {x for x in focal if x}
    order = sorted({times[n] for n in names})
    across = {t: 2 * i / (len(order) - 1) - 1 if len(order) > 1 else 0.0 for i, t in enumerate(order)}
    out = {n: (across[times[n]], 0.0) for n in names}
    for t in order:
        rest = [n for n in names if times[n] == t and n not in focal]
        for i, n in enumerate(rest):
            out[n] = (across[t], 0.5 if len(rest) == 1 else (i - (len(rest) - 1) / 2) * APART)
    return out


def model_nodes(claims: DataFrame, registry: Registry, focal: Iterable[str] = ()) -> DataFrame:
    """(model_id, node, x, y) of the nodes that models hold present."""
    spots = node_places([r["source"] for r in registry.nodes], node_times(registry), focal)
    at = claims.sparkSession.createDataFrame([(r["comp_id"], r["source"], *spots[r["source"]]) for r in registry.nodes], "comp_id string, node string, x double, y double")
    return claims.where(F.col("status").isin("present", "causal")).join(F.broadcast(at), "comp_id").select("model_id", "node", "x", "y")


def model_edges(claims: DataFrame, registry: Registry, focal: Iterable[str] = ()) -> DataFrame:
    """(model_id, comp_id, source, target, direction, status, line, x, y, xend, yend): causal edges are solid, unknown ones dashed, others left out."""
    spots = node_places([r["source"] for r in registry.nodes], node_times(registry), focal)
    rows = [(r["comp_id"], r["source"], r["target"], r["direction"], *spots[r["source"]], *spots[r["target"]]) for r in registry.edges]
    at = claims.sparkSession.createDataFrame(rows, "comp_id string, source string, target string, direction string, x double, y double, xend double, yend double")
    line = F.when(F.col("status") == "unknown", "dashed").otherwise("solid")
    return claims.where(F.col("status").isin("causal", "present", "unknown")).join(F.broadcast(at), "comp_id").select("model_id", "comp_id", "source", "target", "direction", "status", line.alias("line"), "x", "y", "xend", "yend")


def adjustment_labels(claims: DataFrame, registry: Registry, exposure: str, outcome: str) -> DataFrame:
    """(model_id, label): the adjustment sets of each model as text."""
    sets = F.transform("robust_mas", lambda z: F.concat(F.lit("{"), F.concat_ws(", ", z), F.lit("}")))
    text = F.when(F.col("robust_mas").isNull(), "unavailable").when(F.size("robust_mas") == 0, "none").otherwise(F.array_join(sets, "; "))
    return P.build(M.pack(claims, registry), registry, exposure, outcome).select("model_id", F.concat(F.lit("Adjust for: "), text).alias("label"))


def timeline(result: Result | DataFrame) -> DataFrame:
    """(step_order, step, compatibility, label) of a crux, in the order in which things are settled."""
    df = result if isinstance(result, DataFrame) else result.frames.get("timeline")
    if df is None or not {"step", "compatibility"} <= set(df.columns):
        raise ScenarioError("there is no timeline: steps and their compatibility are needed")
    return df.withColumn("label", F.format_string("%.3f", F.col("compatibility").cast("double")))


def precision_bars(results: dict, spark) -> DataFrame:
    """(metric, value): how alike models look, and how many pairs agree."""
    return spark.createDataFrame([("Mean structural similarity", results["mean_similarity_rate"]), (LABEL[results["metric"]], results["compatibility_rate"])], "metric string, value double")


def simulation(result: Result) -> dict[str, DataFrame]:
    """The frames of a scenario's own plots."""
    f = result.frames
    if result.scenario in ("crux_of_certainty", "crux"):
        return {"compatibility_timeline": timeline(result)} | ({"lynchpin_ranking": ranking(f["rankings"])} if "rankings" in f else {})
    if result.scenario == "ghost_cluster":
        marked = f["embedding"].join(f["order"].select("model_id", "cluster_id", "label"), "model_id")
        return {"cluster_sizes": f["contrast"].select("cluster_id", "model_count", "label"), "cluster_embedding": marked, "cluster_labels": U.label_centroids(f["embedding"], f["order"])}
    if result.scenario == "precision_illusion":
        return {"precision_comparison": precision_bars(result.results, f["claims"].sparkSession)}
    raise ScenarioError(f"no plots of {result.scenario}", "INVALID_SCENARIO")


def showcase(result: Result) -> dict[str, DataFrame]:
    """The frames of the longer report on a scenario: what models claim, and what moves or groups them."""
    f = result.frames
    edges = f["claims"].where(F.col("comp_id").isin([r["comp_id"] for r in result.registry.edges]))
    out = {"component_status_heatmap": U.status_heatmap(edges)}
    if "shift" in f:
        out |= {"compatibility_shift": f["shift"], "shift_summary": f["shift_summary"]}
    if "contrast" in f:
        out |= {"clustered_dyad_heatmap": U.heatmap(f["scores"], f["assignments"], f["contrast"]), "cluster_breaks": f["breaks"], "ghost_contrast": f["contrast"]}
    if "model_metrics" in f:
        out["consensus_contrast"] = U.outliers(f["model_metrics"])
    return out


def ranking(ranked: DataFrame, top: int = 20) -> DataFrame:
    """(rank, component_id, edge, best_resolution, delta_u) of the best cruxes."""
    return ranked.where(F.col("rank") <= top).select("rank", "component_id", F.concat_ws(" -> ", "source", "target").alias("edge"), "best_resolution", "delta_u")
