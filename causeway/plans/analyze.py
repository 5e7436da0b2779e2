"""The whole analysis in one call: registry, models, pairs, cruxes, and clusters far from a prior."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.durable import durable
from causeway.operators import clusters as C
from causeway.operators import dyads as D
from causeway.operators import expansion as X
from causeway.operators import models as M
from causeway.operators import profiles as P
from causeway.operators import summaries as U
from causeway.operators.crux import Crux
from causeway.sources import registry as R


@dataclass
class Analysis:
    registry: R.Registry
    report: dict
    claims: DataFrame
    models: DataFrame
    dyads: DataFrame
    profiles: DataFrame | None
    crux: DataFrame | None
    contrast: DataFrame | None

    def summary(self) -> dict:
        """What the client reports, each a row or a few."""
        out = {"registry": self.registry.summary(), "expansion": self.report, "models": self.models.count(), "mean_similarity": self.dyads.agg(F.avg("similarity_rate")).first()[0]}
        if self.profiles is not None:
            sets = durable(U.adjustment_prevalence(self.profiles))
            out["adjustment_sets"] = [r.asDict() for r in sets.orderBy(F.desc("models"), "adjustment_set").limit(20).collect()]
            out["prevalent_sets"] = U.most_prevalent(sets).first().asDict()
            out["compatibility"] = {r["metric"]: r.asDict() for r in U.compatibility_share(self.dyads, "mas_compatible", "identified_compatible").collect()}
            out["identified"] = U.identified_models(self.profiles).first().asDict()
            out["missing_components"] = [r.asDict() for r in U.missing_components(self.profiles).limit(20).collect()]
        return out


def analyze(spark: SparkSession, nodes: list[dict], exposure: str | None = None, outcome: str | None = None, constraints: list[dict] | None = None, mode: str = "sampled", n_models: int = 200, seed: int = 42, prior: str | None = None, rank: bool = True, **options) -> Analysis:
    """``mode``: sampled or exhaustive. Cruxes are ranked where the models are closed under settling edges, as exhaustive ones are."""
    reg = R.build(nodes, constraints=constraints, exposure=exposure, outcome=outcome)
    made = X.expand(spark, reg, mode, n_models, seed, **options)
    claims = durable(made.claims)
    models = durable(M.pack(claims, reg))
    dyads = D.all_pairs(models, reg)
    profiles = durable(P.build(models, reg, exposure, outcome)) if exposure else None
    if profiles is not None:
        dyads = P.compare(dyads, profiles)
    crux = Crux(models, reg).rank() if rank and mode == "exhaustive" and M.unknown_edges(models, reg).limit(1).count() else None
    contrast = None
    if prior is not None:
        scores = durable(dyads.select("ego_id", "alter_id", F.col("similarity_rate").alias("score")))
        found = C.detect(scores)
        contrast = C.contrast(scores, durable(found), prior) if found is not None else None
    return Analysis(reg, made.report, claims, models, dyads, profiles, crux, contrast)
