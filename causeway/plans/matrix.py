"""Pairs of models in one call, by mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.errors import DyadError
from causeway.operators import dyads as D
from causeway.operators import models as M
from causeway.operators import profiles as P
from causeway.plans import formulas as B
from causeway.plans import symbolic
from causeway.sources.registry import Registry

MODES = ("basic", "full", "single-ref", "two-stage", "symbolic")
BASIC = ["dyad_id", "ego_id", "alter_id", "similarity_rate", "timing_compatible", "existence_conflict", "repair_cost"]
CAUSAL = {"mas_ego": "array<array<string>>", "mas_alter": "array<array<string>>", "mas_compatible": "boolean", "identified_ego": "boolean", "identified_alter": "boolean", "identified_compatible": "boolean"}


def dyad_matrix(spark: SparkSession, claims: DataFrame | None, registry: Registry, mode: str = "basic", reference: str | None = None, top_k: int = 100, exposure: str | None = None, outcome: str | None = None, constraint: tuple = B.TRUE, criterion: str = "back-door", **options) -> DataFrame:
    """``basic``: every pair's rates; ``full``: all of the record with the causal metrics; ``single-ref``: one model as ego; ``two-stage``:
    the full record of the ``top_k`` most similar pairs; ``symbolic``: the weighted query classes of all models that the registry allows.

    Without an effect the causal metrics are null. Symbolic classes need an effect, and no claims.
    """
    if mode not in MODES:
        raise DyadError(f"no mode {mode}; there are {', '.join(MODES)}", "INVALID_MODE")
    exposure, outcome = exposure or registry.meta.get("exposure"), outcome or registry.meta.get("outcome")
    if (exposure is None) != (outcome is None):
        raise DyadError("exposure and outcome are given together or not at all", "MISSING_EXPOSURE_OUTCOME")
    if mode == "symbolic":
        if exposure is None:
            raise DyadError("symbolic classes are about an effect", "MISSING_EXPOSURE_OUTCOME")
        u = symbolic.from_registry(registry, exposure, outcome)
        fixed, _ = symbolic.constraints(u)
        return symbolic.query_classes(spark, u, B.conj(fixed, constraint), **options)
    if mode == "single-ref" and reference is None:
        raise DyadError("a reference model is needed", "INVALID_REFERENCE")
    models = M.pack(M.require_valid(claims, registry), registry)
    if mode == "basic":
        return D.all_pairs(models, registry).select(*BASIC)
    if mode == "single-ref":
        pairs = D.single_reference(models, registry, reference)
    else:
        pairs = D.two_stage(models, registry, top_k) if mode == "two-stage" else D.all_pairs(models, registry)
    if exposure is None:
        return pairs.withColumns({c: F.lit(None).cast(t) for c, t in CAUSAL.items()})
    return P.compare(pairs, P.build(models, registry, exposure, outcome, criterion))
