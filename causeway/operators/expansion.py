"""Expansion of a registry into its models: every combination, or a seeded sample of them.

The driver lays out the spaces (which nodes are present, when, and what each edge may claim); executors decode running numbers
into claims and drop cyclic ones. Numbers are given after that, in the order of the spaces with the last edge varying fastest.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.errors import ExpansionError
from causeway.functions.durable import durable, number_rows
from causeway.functions.graphs import Graph
from causeway.sources.registry import Registry

MOST_MODELS, ASK_BEYOND, SAMPLED, ATTEMPTS = 10_000, 10_000, 100, 50
DIRECTED, BIDIRECTED = ("causal", "unknown", "non-causal"), ("present", "absent")
CLAIMS = "idx long, comp_id string, status string, timing int"
NAMED = "model_id string, comp_id string, status string, timing int"


@dataclass
class Space:
    nodes: list[str]
    timing: dict[str, int | None]
    fixed: list[tuple[str, str]]
    choices: list[tuple[str, tuple[str, ...]]]
    count: int


@dataclass
class Plan:
    spaces: list[Space]
    offsets: list[int]
    projected: int
    report: dict[str, int] = field(default_factory=dict)


def _subsets(registry: Registry, policy: str, required: set[str]):
    ids = [r["comp_id"] for r in registry.nodes]
    if policy == "all-present":
        return [ids]
    if policy == "optional":  # required nodes, and any of the others
        free = [i for i in ids if i not in required]
        return [[i for i in ids if i in required or i in pick] for k in range(len(free) + 1) for pick in combinations(free, k) if k or required]
    if policy == "all-subsets":
        return [list(pick) for k in range(1, len(ids) + 1) for pick in combinations(ids, k) if required <= set(pick)]
    raise ExpansionError(f"no node policy {policy}")


def plan(registry: Registry, edge_statuses=DIRECTED, bidirected_statuses=BIDIRECTED, node_policy: str = "all-present", required_nodes=(), timing_options: dict[str, list[int]] | None = None, settle_ineligible: bool = False) -> Plan:
    """``timing_options`` (by node name) makes timing strict: an edge against it is left out, or claimed non-causal with ``settle_ineligible``."""
    for own, allowed in ((edge_statuses, DIRECTED), (bidirected_statuses, BIDIRECTED)):
        if not own or len(set(own)) < len(own) or not set(own) <= set(allowed):
            raise ExpansionError(f"statuses must be different ones of {allowed}")
    if any(r["fixed_status"] for r in registry.edges if r["direction"] == "->") and "causal" not in edge_statuses:
        raise ExpansionError("an edge is fixed as causal, so causal must be a status")
    strict = timing_options is not None
    base = registry.meta.get("timing") or {}
    required = {registry.node_id[x] for x in required_nodes}
    name = {r["comp_id"]: r["source"] for r in registry.nodes}
    report = dict.fromkeys(("node_subsets", "timing_assignments", "pruned_timing", "pruned_fixed", "pruned_empty", "projected", "generated", "pruned_cycles"), 0)
    spaces = []
    for nodes in _subsets(registry, node_policy, required):
        report["node_subsets"] += 1
        options = [(timing_options or {}).get(name[i]) or [base.get(name[i])] for i in nodes]
        for times in product(*options):
            report["timing_assignments"] += 1
            t = dict(zip(nodes, times, strict=True))
            fixed, choices, ok = [], [], True
            for r in registry.edges:
                s, e = registry.ends(r["comp_id"])
                if s not in t or e not in t:
                    if r["fixed_status"]:
                        ok = False
                        report["pruned_fixed"] += 1
                        break
                    continue
                against = r["direction"] == "->" and t[s] is not None and t[e] is not None and t[s] >= t[e]
                if r["fixed_status"]:
                    if against:
                        ok = False
                        report["pruned_timing"] += 1
                        break
                    fixed.append((r["comp_id"], "causal"))
                    continue
                own = tuple(edge_statuses if r["direction"] == "->" else bidirected_statuses)
                if against and strict:
                    if settle_ineligible:
                        fixed.append((r["comp_id"], "non-causal"))
                    continue
                if against:
                    own = tuple(x for x in own if x != "causal")
                if not own:
                    ok = False
                    report["pruned_empty"] += 1
                    break
                choices.append((r["comp_id"], own))
            if ok:
                count = 1
                for _, own in choices:
                    count *= len(own)
                spaces.append(Space(nodes, t, fixed, choices, count))
    offsets, total = [], 0
    for s in spaces:
        offsets.append(total)
        total += s.count
    report["projected"] = total
    return Plan(spaces, offsets, total, report)


class Decoder:
    def __init__(self, p: Plan, registry: Registry):
        self.p = p
        self.ends = {r["comp_id"]: registry.ends(r["comp_id"]) for r in registry.edges if r["direction"] == "->"}
        self.at = {r["comp_id"]: i for i, r in enumerate(registry.nodes)}

    def __call__(self, idx: int):
        """The claims of a number, or None if they have a directed cycle."""
        k = bisect_right(self.p.offsets, idx) - 1
        rest, digits = idx - self.p.offsets[k], []
        for _, own in reversed(self.p.spaces[k].choices):
            rest, d = divmod(rest, len(own))
            digits.append(d)
        return self.of(k, reversed(digits))

    def of(self, k: int, digits):
        """The claims of a space's model by its digits, the first edge's first."""
        s = self.p.spaces[k]
        edges = sorted([*s.fixed, *((comp, own[int(d)]) for (comp, own), d in zip(s.choices, digits, strict=True))])
        on = {(self.at[self.ends[c][0]], self.at[self.ends[c][1]]) for c, st in edges if st == "causal" and c in self.ends}
        if not Graph(len(self.at), on).acyclic():
            return None
        return [(n, "present", s.timing[n]) for n in s.nodes] + [(c, st, None) for c, st in edges]


def _decoded(numbers: DataFrame, p: Plan, registry: Registry) -> DataFrame:
    decode = Decoder(p, registry)

    def run(batches):
        for x in batches:
            rows = [(i, *c) for i in x.column(0).to_pylist() for c in decode(i) or ()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32()))], ["idx", "comp_id", "status", "timing"])

    return numbers.mapInArrow(run, CLAIMS)


def exhaustive(spark: SparkSession, registry: Registry, max_models: int = MOST_MODELS, allow_large: bool = False, **options) -> DataFrame:
    """(model_id, comp_id, status, timing) of every acyclic model."""
    p = plan(registry, **options)
    if p.projected > max_models:
        raise ExpansionError(f"{p.projected} models are projected, {max_models} allowed")
    if p.projected > ASK_BEYOND and not allow_large:
        raise ExpansionError(f"{p.projected} models are projected; say allow_large")
    parts = max(1, min(200, -(-p.projected // 2000)))
    kept = _decoded(spark.range(0, p.projected, 1, parts), p, registry).withColumn("part", F.spark_partition_id()).persist()
    # numbers without a single-partition sort: models of earlier partitions, then the place in one's own
    per = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.count_distinct("idx").alias("n")).collect()}
    before, total = {}, 0
    for k in range(parts):
        before[k], total = total, total + per.get(k, 0)
    return _named(kept, before, max(4, len(str(total))))


def _named(kept: DataFrame, before: dict[int, int], width: int) -> DataFrame:
    def run(batches):
        now, at = None, None
        for x in batches:
            cols, ids = x.to_pydict(), []
            for i, part in zip(cols["idx"], cols["part"], strict=True):
                if i != now:
                    at = before[part] + 1 if now is None else at + 1
                    now = i
                ids.append(f"M{at:0{width}d}")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), x.column(1), x.column(2), x.column(3)], ["model_id", "comp_id", "status", "timing"])

    return kept.mapInArrow(run, NAMED)


#: Digits of a draw are kept modulo this, a multiple of every number of choices.
_RADIX = 6


class Draws:
    """Models as (space, digits): a space is drawn by its share of all models, every digit by a hash of its own, so their number may be of any size."""

    def __init__(self, p: Plan):
        total, at = 0, []
        for s in p.spaces:
            total += s.count
            at.append(total)
        self.shares = [float(Fraction(x, total)) for x in at]
        self.sizes = [[len(own) for _, own in s.choices] for s in p.spaces]
        self.longest = max(map(len, self.sizes), default=0)

    def space(self, u: float) -> int:
        return min(bisect_right(self.shares, u), len(self.shares) - 1)

    def key(self, k: int, digits) -> str:
        """Sorts as the running numbers of the models do."""
        return f"{k:08d}" + "".join(str(d % n) for d, n in zip(digits, self.sizes[k], strict=False))


def sampled(spark: SparkSession, registry: Registry, n_models: int = SAMPLED, seed: int = 42, **options) -> DataFrame:
    """Different acyclic models by hashed draws: the same for a seed however the work is dealt out. At most ATTEMPTS draws a model are made."""
    return _sample(spark, registry, plan(registry, **options), n_models, seed)[0]


def _sample(spark: SparkSession, registry: Registry, p: Plan, n_models: int, seed: int) -> tuple[DataFrame, dict[str, int]]:
    if not p.projected or n_models < 1:
        return spark.createDataFrame([], NAMED), {"generated": 0, "pruned_cycles": 0}
    draw, decode = Draws(p), Decoder(p, registry)

    def keys(batches):
        for x in batches:
            ids, at, ok = x.column(0).to_pylist(), [], []
            for u, digits in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                k = draw.space(u)
                at.append(draw.key(k, digits))
                ok.append(decode.of(k, at[-1][8:]) is not None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.string()), pa.array(ok, pa.bool_())], ["id", "key", "ok"])

    most, m = n_models * ATTEMPTS, 2 * n_models
    while True:  # more draws only where those so far did not give enough
        u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / float(1 << 52)
        digits = F.transform(F.sequence(F.lit(0), F.lit(max(draw.longest - 1, 0))), lambda j: F.pmod(F.xxhash64(F.lit(seed), "id", j), F.lit(_RADIX)).cast("int"))
        drawn = spark.range(min(m, most)).select("id", u.alias("u"), digits.alias("digits")).mapInArrow(keys, "id long, key string, ok boolean")
        first = durable(drawn.groupBy("key").agg(F.min("id").alias("id"), F.first("ok").alias("ok")))
        good = first.where("ok")
        if m >= most or good.count() >= n_models:
            break
        m *= 4
    pick = good.orderBy("id").limit(n_models).select("key")
    numbered = number_rows(pick, "key", name="number")
    width = max(4, len(str(n_models)))

    def rows(batches):
        for x in batches:
            out = [(f"M{n:0{width}d}", *c) for key, n in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True) for c in decode.of(int(key[:8]), key[8:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], ["model_id", "comp_id", "status", "timing"])

    cyclic = first.where("not ok").count()
    return numbered.select("key", "number").mapInArrow(rows, NAMED), {"generated": min(good.count(), n_models), "pruned_cycles": cyclic}


@dataclass
class Expansion:
    """Claims of all models, and how many were projected, made and left out for what."""

    claims: DataFrame
    report: dict[str, int]


def expand(spark: SparkSession, registry: Registry, mode: str = "sampled", n_models: int = SAMPLED, seed: int = 42, max_models: int = MOST_MODELS, allow_large: bool = False, seeds: DataFrame | None = None, **options) -> Expansion:
    """Models by either mode, with the seeds' claims first if there are any, and the report."""
    if mode not in ("sampled", "exhaustive"):
        raise ExpansionError(f"no mode {mode}")
    if max_models < 1:
        raise ExpansionError("max_models must be positive")
    p = plan(registry, **options)
    if mode == "sampled":
        claims, more = _sample(spark, registry, p, min(n_models, max_models), seed)
    else:
        claims = exhaustive(spark, registry, max_models, allow_large, **options)
        made = claims.select("model_id").distinct().count()
        more = {"generated": made, "pruned_cycles": p.projected - made}
    if seeds is not None:
        claims = with_seeds(claims, seeds, registry, options.get("timing_options"))
    return Expansion(claims, p.report | more)


def with_seeds(generated: DataFrame, seeds: DataFrame, registry: Registry, timing_options: dict[str, list[int]] | None = None) -> DataFrame:
    """Seed models first, under their own ids; each takes the place of one generated model that claims the same. The rest are numbered on after them.

    Claims of an edge imply its ends. A seed must claim fixed edges causal, and times that the options allow.
    """
    from causeway.operators import models as M

    spark = generated.sparkSession
    M.require_valid(seeds, registry)
    allowed = timing_options or registry.meta.get("timing_options") or {}
    options = [(registry.node_id[k], v) for k, v in allowed.items() if v]
    if options:
        own = spark.createDataFrame(options, "comp_id string, allowed array<int>")
        if bad := seeds.where("timing is not null").join(F.broadcast(own), "comp_id").where(~F.array_contains("allowed", F.col("timing"))).first():
            raise ExpansionError(f"{bad['model_id']} claims a time for {bad['comp_id']} that isn't one of {bad['allowed']}")
    ends = spark.createDataFrame([(r["comp_id"], *registry.ends(r["comp_id"])) for r in registry.edges], "edge string, s string, t string")
    implied = seeds.join(F.broadcast(ends), seeds["comp_id"] == ends["edge"]).where("status <> 'absent'").select("model_id", F.explode(F.array("s", "t")).alias("comp_id")).distinct().join(seeds.select("model_id", "comp_id"), ["model_id", "comp_id"], "left_anti")
    time = {registry.node_id[k]: v for k, v in (registry.meta.get("timing") or {}).items()}
    time = {c: time.get(c) if time.get(c) is not None else v[0] for c, v in [*((c, [None]) for c in time), *options]}
    times = F.create_map(*(F.lit(x) for kv in time.items() for x in kv)) if time else F.create_map().cast("map<string,int>")
    full = seeds.select("model_id", "comp_id", "status", F.coalesce("timing", F.try_element_at(times, F.col("comp_id")).cast("int")).alias("timing")).union(implied.select("model_id", "comp_id", F.lit("present"), F.try_element_at(times, F.col("comp_id")).cast("int")))
    full = durable(full)
    for comp in (r["comp_id"] for r in registry.edges if r["fixed_status"]):
        ok = full.where((F.col("comp_id") == comp) & F.col("status").isin("causal", "present")).select("model_id")
        if bad := full.select("model_id").distinct().join(ok, "model_id", "left_anti").first():
            raise ExpansionError(f"{bad[0]} must claim {comp} causal")
    # seed k of a signature takes the k-th generated model of it
    turn = F.row_number().over(Window.partitionBy("sig").orderBy("model_id")).alias("turn")
    sig = M.signature(registry).alias("sig")
    taken = M.pack(full, registry).select("model_id", sig).select("sig", turn)
    made = M.pack(generated, registry).select("model_id", sig).select("model_id", "sig", turn)
    rest = made.join(taken, ["sig", "turn"], "left_anti").select("model_id")
    used = [r[0] for r in full.select("model_id").distinct().orderBy("model_id").collect()]  # seeds are given by hand
    numbered = number_rows(rest, "model_id", name="place")
    width = max(4, len(str(len(used) + numbered.count())))
    # numbers go on after the seeds and skip those that are seeds' ids
    skip = sorted(int(u[1:]) for u in used if re.fullmatch(rf"M\d{{{width},}}", u) and u == f"M{int(u[1:]):0{width}d}" and int(u[1:]) > len(used))
    number = F.col("place") + len(used)
    for x in skip:
        number = F.when(number >= x, number + 1).otherwise(number)
    names = numbered.select("model_id", F.format_string(f"M%0{width}d", number.cast("long")).alias("new"))
    left = generated.join(names, "model_id").select(F.col("new").alias("model_id"), "comp_id", "status", "timing", F.lit(False).alias("seeded"))
    return M.unpack(M.pack(full, registry), registry).withColumn("seeded", F.lit(True)).unionByName(left)
