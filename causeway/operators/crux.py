"""Crux: which open edge, settled one way, would most raise mean compatibility of all pairs.

Settling an edge maps each model in which it is open to the model that has the settled signature; nothing is recomputed but the
metric of pairs that this touches. Similarity is symmetric, so pairs are summed once with the changed model first.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.errors import CruxError
from causeway.functions import bits
from causeway.operators import dyads as D
from causeway.operators import models as M
from causeway.operators import profiles as P
from causeway.operators import signatures as S
from causeway.sources.registry import Registry

STATUSES = ("causal", "non-causal")
LEAST = 1e-12
THRESHOLD = 0.1
#: Models that one task compares the changed ones of a move with.
BLOCK = 4096


def _similarity(registry: Registry) -> Callable[[str, str], Column]:
    def metric(left: str, right: str) -> Column:
        c = D.counters(registry, left, right)
        return D.similarity(c["shared"], c["union_claims"])

    return metric


def _mas(left: str, right: str) -> Column:
    return P.mas_compatible(F.col(f"{left}robust_mas"), F.col(f"{right}robust_mas")).cast("double")


def _identified(left: str, right: str) -> Column:
    return P.identified_compatible(*(F.col(f"{side}{c}") for c in ("identified", "nodes") for side in (left, right))).cast("double")


def metric_of(name: str, registry: Registry) -> Callable[[str, str], Column]:
    try:
        return {"similarity_rate": _similarity(registry), "mas_compatible": _mas, "identified_compatible": _identified}[name]
    except KeyError:
        raise CruxError(f"no metric {name}", "INVALID_COMPATIBILITY_METRIC") from None


class Crux:
    """The open edges of a set of packed models under one metric. ``profiles``: for causal metrics."""

    def __init__(self, models: DataFrame, registry: Registry, metric: str = "similarity_rate", profiles: DataFrame | None = None):
        self.registry, self.metric = registry, metric_of(metric, registry)
        if metric != "similarity_rate":
            if profiles is None:
                raise CruxError("a causal metric needs profiles", "MISSING_EXPOSURE_OUTCOME")
            models = models.join(profiles.select("model_id", "robust_mas", "identified", "nodes"), "model_id", "left")
        self.models = models.persist()
        self.n = self.models.count()
        base = D.pairs(self.models, registry, size=self.n).agg(F.avg(self.metric("e_", "a_")).alias("m"), F.count_if(self.metric("e_", "a_").isNull()).alias("z")).first()
        if base["z"]:
            raise CruxError(f"the metric is null for {base['z']} pairs", "DELTA_U_ERROR")
        self.baseline = base["m"]

    def close(self) -> None:
        """Gives the kept models free."""
        self.models.unpersist()

    def uncertain(self) -> list[str]:
        return [r[0] for r in M.unknown_edges(self.models, self.registry).select("comp_id").distinct().orderBy("comp_id").collect()]

    def mapping(self, moves: list[tuple[str, dict[str, str]]]) -> DataFrame:
        """(move, model_id, forced, valid, source_id) of the models that each move changes. A move settles some edges where they are open."""
        reg, n = self.registry, self.registry.words
        sets = []
        for label, own in moves:
            words = [bits.literal([reg.ordinal[c] for c, s in own.items() if s == want], n) for want in STATUSES]
            sets.append(F.struct(F.lit(label).alias("move"), *(F.lit(w).cast("bigint").alias(f"{k}{i}") for k, ws in zip("cx", words, strict=True) for i, w in enumerate(ws))))
        open_ = M.unknown(reg)
        m = self.models.select("model_id", *(f"{k}{i}" for k in ("np", "app", "cm", "xm") for i in range(n)), "timing", *(w.alias(f"open{i}") for i, w in enumerate(open_)), F.explode(F.array(*sets)).alias("s"))
        hit = [(F.col(f"open{i}").bitwiseAND(F.col(f"s.c{i}").bitwiseOR(F.col(f"s.x{i}")))) for i in range(n)]
        m = m.where(bits.any_set(hit)).select(
            F.col("s.move").alias("move"), "model_id", bits.count(hit).alias("forced"), *(f"np{i}" for i in range(n)), *(f"app{i}" for i in range(n)),
            *(F.col(f"{k}m{i}").bitwiseOR(F.col(f"open{i}").bitwiseAND(F.col(f"s.{k}{i}"))).alias(f"{k}m{i}") for k in "cx" for i in range(n)), "timing",
        )
        check = S.Checker(reg)

        def run(batches):
            for x in batches:
                cols = x.to_pydict()
                # edges still open may be causal later; only what is claimed decides
                ok = [check.valid(S.to_int([cols[f"cm{i}"][r] for i in range(n)]) | check.fixed & ~S.to_int([cols[f"xm{i}"][r] for i in range(n)]), cols["timing"][r]) for r in range(len(x))]
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(ok, pa.bool_())], [*x.schema.names, "valid"])

        from pyspark.sql.types import BooleanType, StructField, StructType

        m = m.mapInArrow(run, StructType([*m.schema.fields, StructField("valid", BooleanType())]))
        sig = M.signature(reg).alias("sig")
        first = self.models.select(sig, "model_id").groupBy("sig").agg(F.min("model_id").alias("source_id"))
        return m.select("move", "model_id", "forced", "valid", sig).join(first, "sig", "left").select("move", "model_id", "forced", "valid", F.when(F.col("valid"), F.col("source_id")).alias("source_id"))

    def effects(self, moves: list[tuple[str, dict[str, str]]]) -> DataFrame:
        """Per move: change of the mean, pairs better and worse, models changed, edges settled, and how many models found their match."""
        a = self.mapping(moves).persist()
        cover = a.groupBy("move").agg(F.count("*").alias("models_changed"), F.sum("forced").alias("instances_forced"), F.count_if(~F.col("valid")).alias("invalid_models"), F.count_if(F.col("valid") & F.col("source_id").isNull()).alias("unmatched_models"), F.count("source_id").alias("matched"))
        own = [c for c in self.models.columns]
        side = lambda p: self.models.select(*(F.col(c).alias(f"{p}{c}") for c in own))
        found = a.where("source_id is not null").select("move", "model_id", "source_id")
        e = found.withColumnsRenamed({"model_id": "e_model_id", "source_id": "pe_model_id"}).join(side("e_"), "e_model_id").join(side("pe_"), "pe_model_id")
        goes = found.select("move", F.col("model_id").alias("a_model_id"), "source_id")
        alters = F.broadcast(found.select("move").distinct()).crossJoin(side("a_")) if self.n else side("a_").withColumn("move", F.lit(""))
        alters = alters.join(goes, ["move", "a_model_id"], "left").withColumn("pa_model_id", F.coalesce("source_id", "a_model_id")).join(side("pa_"), "pa_model_id")
        # a move's pairs are dealt to as many tasks as blocks of models
        blocks = max(1, -(-self.n // BLOCK))
        alters = alters.withColumn("_block", F.pmod(F.xxhash64("a_model_id"), F.lit(blocks)))
        e = e.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        p = e.join(alters, ["move", "_block"]).where("e_model_id <> a_model_id")
        change = self.metric("pe_", "pa_") - self.metric("e_", "a_")
        weight = F.when(F.col("source_id").isNull(), 2).otherwise(1)
        sums = p.select("move", change.alias("c"), weight.alias("w")).groupBy("move").agg(F.sum(F.col("c") * F.col("w")).alias("total"), F.coalesce(F.sum(F.when(F.col("c") > LEAST, F.col("w"))), F.lit(0)).alias("dyads_improved"), F.coalesce(F.sum(F.when(F.col("c") < -LEAST, F.col("w"))), F.lit(0)).alias("dyads_worsened"), F.count_if(F.col("c").isNull()).alias("nulls"))
        out = cover.join(sums, "move", "left")
        return out.select("move", (F.coalesce("total", F.lit(0.0)) / max(self.n * (self.n - 1), 1)).alias("delta"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("dyads_improved", "dyads_worsened", "nulls")), "models_changed", "instances_forced", "invalid_models", "unmatched_models", (F.col("matched") / F.col("models_changed")).alias("mapping_coverage"))

    def rank(self, top_k: int | None = 10, components: list[str] | None = None, closed: bool = True) -> DataFrame:
        """Marginal cruxes, the best first; ties by component. With ``closed`` models without a match raise."""
        comps = self.uncertain() if components is None else components
        e = self.effects([(f"{c}|{s}", {c: s}) for c in comps for s in STATUSES]) if comps else None
        if e is None:
            raise CruxError("no edge is open", "COMPONENT_NOT_FOUND")
        if closed and (bad := e.where("mapping_coverage < 1 or nulls > 0").first()):
            raise CruxError(f"the models are not closed under settling {bad['move']}")
        e = e.withColumns({"component_id": F.substring_index("move", "|", 1), "status": F.substring_index("move", "|", -1)})
        of = lambda s, c: F.max(F.when(F.col("status") == s, F.col(c)))
        out = e.groupBy("component_id").agg(
            *(F.coalesce(F.bround(of(s, "delta"), 6), F.lit(0.0)).alias(f"delta_u_{s.replace('-', '_')}") for s in STATUSES),
            *(of(s, c).alias(f"{c}_{s.replace('-', '_')}") for c in ("dyads_improved", "dyads_worsened", "models_changed", "instances_forced", "mapping_coverage", "invalid_models", "unmatched_models") for s in STATUSES),
        )
        pos, neg = F.col("delta_u_causal"), F.col("delta_u_non_causal")
        out = out.withColumns({"delta_u": F.greatest(pos, neg, F.lit(0.0)), "best_resolution": F.when(F.greatest(pos, neg) <= LEAST, F.lit(None)).when(pos >= neg, "causal").otherwise("non-causal")})
        out = out.withColumns({"baseline_compatibility": F.lit(round(self.baseline, 6)), **{f"post_compatibility_{s}": F.bround(F.lit(self.baseline) + F.col(f"delta_u_{s}"), 6) for s in ("causal", "non_causal")}})
        ends = out.sparkSession.createDataFrame([(r["comp_id"], r["type"], r["source"], r["target"]) for r in self.registry.edges], "component_id string, type string, source string, target string")
        out = out.join(F.broadcast(ends), "component_id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("delta_u"), "component_id")))  # one row an edge
        return out.where(F.col("rank") <= top_k) if top_k else out

    def two_stage(self, screen: Crux, top_k: int = 10, threshold: float = THRESHOLD) -> DataFrame:
        """Ranks only edges whose structural crux (of ``screen``) reaches the threshold: approximate by design."""
        kept = [r[0] for r in screen.rank(None).where(F.col("delta_u") >= threshold).select("component_id").collect()]
        return self.rank(top_k, kept)

    def everything(self, status: str) -> dict:
        """Settles every open edge one way: the global crux."""
        if status not in STATUSES:
            raise CruxError("the global crux settles edges causal or non-causal")
        r = self.effects([("all", {x["comp_id"]: status for x in self.registry.edges})]).first()
        if r is None:
            return {"crux_mode": "global", "target_status": status, "baseline_compatibility": round(self.baseline, 6), "feasible": True, "post_compatibility": round(self.baseline, 6), "compatibility_change": 0.0, "delta_u": 0.0, "models_changed": 0, "unknown_instances_forced": 0}
        feasible = r["mapping_coverage"] == 1
        post = round(self.baseline + r["delta"], 6) if feasible else None
        change = round(post - round(self.baseline, 6), 6) if feasible else None
        return {"crux_mode": "global", "target_status": status, "baseline_compatibility": round(self.baseline, 6), "model_count": self.n, "dyad_count": self.n * (self.n - 1), "unknown_instances_forced": r["instances_forced"], "feasible": feasible, "post_compatibility": post, "compatibility_change": change, "delta_u": max(change, 0.0) if feasible else None, "models_changed": r["models_changed"], "dyads_improved": r["dyads_improved"], "dyads_worsened": r["dyads_worsened"], "mapping_coverage": r["mapping_coverage"], "invalid_models": r["invalid_models"], "unmatched_models": r["unmatched_models"]}

    def resolved_pairs(self, component: str, status: str) -> DataFrame:
        """The metric of every pair after settling one edge."""
        return self.settled_pairs({component: status})

    def settled_pairs(self, move: dict[str, str]) -> DataFrame:
        """The metric of every pair after a move."""
        goes = self.mapping([("m", move)]).select("model_id", "source_id")
        if bad := goes.where("source_id is null").first():
            raise CruxError(f"{bad['model_id']}, settled, is none of the models")
        own = self.models.columns
        src = self.models.join(goes, "model_id", "left").select(F.col("model_id").alias("id"), F.coalesce("source_id", "model_id").alias("model_id")).join(self.models, "model_id")
        e, a = (src.select(F.col("id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in own)) for p in ("e_", "a_"))
        return e.crossJoin(F.broadcast(a) if self.n <= 100_000 else a).where("e_id <> a_id").select(F.col("e_id").alias("ego_id"), F.col("a_id").alias("alter_id"), self.metric("e_", "a_").alias("score"))

    def synergy(self, set_size: int = 2, top_n: int = 5, mode: str = "greedy", beam_width: int = 5) -> list[dict]:
        """Sets of edges whose joint settling gains more than each alone; sets of the best singles, or grown from the best sets."""
        if set_size < 2 or mode not in ("greedy", "beam"):
            raise CruxError("a set has two edges at least, and mode is greedy or beam", "INVALID_SYNERGY_REQUEST")
        singles = {r["component_id"]: r for r in self.rank(None).orderBy("rank").limit(top_n).collect()}
        rounds = [list(combinations(singles, set_size))]
        if mode == "beam":
            rounds, now = [], [(c,) for c in singles]
            for _ in range(set_size - 1):
                grown = sorted({tuple(sorted({*s, c})) for s in now for c in singles if c not in s})
                scored = self._joint(grown, singles)
                now = [r["components"] for r in scored[:beam_width]]
                rounds = [now]
        return [r | {"rank": i + 1} for i, r in enumerate(self._joint([tuple(x) for x in rounds[0]], singles))]

    def _joint(self, sets: list[tuple[str, ...]], singles: dict) -> list[dict]:
        moves = [("|".join(f"{c}={s}" for c, s in zip(own, pick, strict=True)), dict(zip(own, pick, strict=True))) for own in sets for pick in product(STATUSES, repeat=len(own))]
        got = {r["move"]: r for r in self.effects(moves).collect()} if moves else {}
        out = []
        for own in sets:
            best = None
            for pick in product(STATUSES, repeat=len(own)):
                r = got.get("|".join(f"{c}={s}" for c, s in zip(own, pick, strict=True)))
                if r is not None and r["mapping_coverage"] == 1 and (best is None or r["delta"] > best[0]):
                    best = (r["delta"], pick)
            if best is None:
                out.append({"components": list(own), "feasible": False, "delta_u_combined": 0.0, "delta_u_individual_sum": 0.0, "synergy_score": 0.0, "best_resolutions": {}})
                continue
            gain = round(round(self.baseline + best[0], 6) - round(self.baseline, 6), 6)
            alone = sum(singles[c][f"delta_u_{s.replace('-', '_')}"] for c, s in zip(own, best[1], strict=True))
            out.append({"components": list(own), "feasible": True, "delta_u_combined": gain, "delta_u_individual_sum": round(alone, 6), "synergy_score": round(gain - alone, 6), "best_resolutions": dict(zip(own, best[1], strict=True)), "post_compatibility": round(self.baseline + best[0], 6), "baseline_compatibility": round(self.baseline, 6)})
        return sorted(out, key=lambda r: (-r["delta_u_combined"], r["components"]))
