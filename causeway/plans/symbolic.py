"""Symbolic spaces of hypotheses: assignments of edge variables, partitioned into weighted query classes.

Constraints and queries are formulas. What constraints say outright is put in first; the variables left are the bits of ``spark.range``, formulas are
columns over it, and classes are one aggregation, however many there are. Beyond ``most_free`` variables a seeded
sample takes the place of all, or classes are counted exactly by decision diagrams as long as these stay small.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.errors import CausalError
from causeway.functions.durable import durable
from causeway.plans import formulas as B
from causeway.sources.registry import Registry

MOST_FREE, SAMPLES, ATOMS, PATH, NODES = 26, 5_000, 16, 8, 200_000
#: Variables of a word of an assignment.
WORD = 62


@dataclass
class Universe:
    """Nodes in causal order, the variable of every edge that may be, and the effect asked for."""

    nodes: list[str]
    edges: list[tuple[str, str]]
    exposure: str
    outcome: str
    fixed: set[tuple[str, str]] = field(default_factory=set)
    hidden: set[str] = field(default_factory=set)
    timing: dict[str, int | None] = field(default_factory=dict)
    components: dict[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self):
        if not {self.exposure, self.outcome} <= set(self.nodes) or self.exposure == self.outcome:
            raise CausalError("exposure and outcome must be two of the nodes", "INVALID_UNIVERSE")
        self.order = _causal_order(self.nodes, self.edges)
        self.names = [name(e) for e in self.edges]

        self._edges = set(self.edges)
        self.components = self.components or {f"S{i + 1:04d}": e for i, e in enumerate(self.edges)}

    def edge(self, s: str, t: str) -> tuple:
        return B.var(name((s, t))) if (s, t) in self._edges else B.FALSE


def name(edge: tuple[str, str]) -> str:
    return "e__" + "__".join(x.translate(str.maketrans("- ", "__")) for x in edge)


def _causal_order(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    left, out = list(nodes), []
    while left:
        free = [n for n in left if not any(t == n and s in left for s, t in edges)]
        if not free:
            raise CausalError("edge variables run in a circle", "INVALID_UNIVERSE")
        out.append(free[0])
        left.remove(free[0])
    return out


def from_nodes(nodes: list[dict], exposure: str, outcome: str) -> Universe:
    """Edges from earlier to later nodes; without any times just the effect itself, and fixed."""
    time = {n["name"]: n.get("timing") for n in nodes}
    hidden = {n["name"] for n in nodes if not n.get("observed", True)}
    if all(t is None for t in time.values()):
        return Universe(list(time), [(exposure, outcome)], exposure, outcome, {(exposure, outcome)}, hidden, time)
    edges = [(s, t) for s in time for t in time if time[s] is not None and time[t] is not None and time[s] < time[t]]
    return Universe(list(time), edges, exposure, outcome, hidden=hidden, timing=time)


def from_hypothesis(edges: list[tuple[str, str]], nodes: list[dict] | None = None, exposure: str | None = None, outcome: str | None = None, timing: dict[str, int | None] | None = None) -> Universe:
    """The universe that a hypothesis speaks of: its nodes, or the ends of its edges; the first and the last stand for an effect that isn't named."""
    if nodes is None:
        nodes = [{"name": n} for n in sorted({x for e in edges for x in e} | {x for x in (exposure, outcome) if x})]
    names = [n["name"] for n in nodes]
    time = timing or {n["name"]: n.get("timing") for n in nodes}
    if len(names) < 2:
        raise CausalError("a hypothesis speaks of two nodes at least", "INVALID_UNIVERSE")
    return from_nodes([{**n, "timing": time.get(n["name"])} for n in nodes], exposure or names[0], outcome or names[-1])


def variable_order(u: Universe) -> list[str]:
    """Variables by the times of source and target, those without a time last, then by name."""
    late = lambda n: (u.timing.get(n) is None, u.timing.get(n) or 0)
    return [name(e) for e in sorted(u.edges, key=lambda e: (late(e[0]), late(e[1]), e))]


def from_registry(registry: Registry, exposure: str, outcome: str) -> Universe:
    arrows = [r for r in registry.edges if r["direction"] == "->"]
    return Universe([r["source"] for r in registry.nodes], [(r["source"], r["target"]) for r in arrows], exposure, outcome, {(r["source"], r["target"]) for r in arrows if r["fixed_status"]}, {r["source"] for r in registry.nodes if not r["observed"]}, registry.meta.get("timing") or {}, {r["comp_id"]: (r["source"], r["target"]) for r in arrows})


class Index:
    """The formulas of a universe's query, each made once."""

    def __init__(self, u: Universe, longest: int = PATH, most_paths: int | None = None, known: dict[str, bool] | None = None):
        """``known``: edges that are settled beforehand, which keeps the formulas of large universes small."""
        self.u, self._reach, self._known = u, {}, known or {}
        self.paths = self._paths(longest, most_paths)
        free = [n for n in u.order if n not in (u.exposure, u.outcome) and n not in u.hidden]
        self.candidates = [frozenset(z) for k in range(len(free) + 1) for z in combinations(free, k)]
        self.valid = {z: self._valid(z) for z in self.candidates}
        self.identifiable = B.disj(*self.valid.values())

    def edge(self, s: str, t: str) -> tuple:
        return B.settle(self.u.edge(s, t), self._known)

    def reach(self, s: str, t: str) -> tuple:
        """Whether a directed path leads from s to t."""
        if (s, t) not in self._reach:
            inner = self.u.order[self.u.order.index(s) + 1 : self.u.order.index(t)] if self.u.order.index(s) < self.u.order.index(t) else []
            self._reach[s, t] = B.disj(self.edge(s, t), *(B.conj(self.edge(s, m), self.reach(m, t)) for m in inner))
        return self._reach[s, t]

    def _paths(self, longest: int, most: int | None) -> list[list[str]]:
        """Simple paths from exposure to outcome whose first edge runs into the exposure."""
        u, out = self.u, []
        near = {n: sorted({b if a == n else a for a, b in u.edges if n in (a, b)}) for n in u.nodes}
        both = set(u.edges)

        def walk(path: list[str]) -> None:
            if most is not None and len(out) >= most:
                return
            if path[-1] == u.outcome:
                out.append(path)
                return
            if len(path) < longest:
                for n in near[path[-1]]:
                    if n not in path and (len(path) > 1 or (n, u.exposure) in both):
                        walk([*path, n])

        walk([u.exposure])
        return out

    def exists(self, path: list[str]) -> tuple:
        return B.conj(*(B.disj(self.edge(a, b), self.edge(b, a)) for a, b in zip(path, path[1:], strict=False)))

    def colliders(self, path: list[str]) -> list[str]:
        both = set(self.u.edges)
        return [b for a, b, c in zip(path, path[1:], path[2:], strict=False) if (a, b) in both and (c, b) in both]

    def opened(self, path: list[str], z: frozenset) -> tuple:
        """Whether the path is there and z leaves it open."""
        inside = set(self.colliders(path))
        if any(n in z for n in path[1:-1] if n not in inside):
            return B.FALSE
        return B.conj(self.exists(path), *(B.TRUE if c in z else B.disj(*(self.reach(c, n) for n in sorted(z) if n != c)) for c in sorted(inside)))

    def _valid(self, z: frozenset) -> tuple:
        below = (self.reach(self.u.exposure, n) for n in sorted(z))
        return B.conj(*(B.neg(f) for f in below), *(B.neg(self.opened(p, z)) for p in self.paths))

    def atoms(self, most: int = ATOMS, prefer: set[str] = frozenset(), projections: int = 2) -> dict[str, tuple]:
        """What tells classes apart, at most so many: identifiability, validity of the empty set, open back doors, the direct edge, risks, two single edges, and the least set's size.

        Single edges are those that the risks speak of, first of all the ``prefer``red (those left open).
        """
        u, none = self.u, frozenset()
        inner = sorted({n for z in self.candidates for n in z})
        collider = B.disj(*(B.conj(self.exists(p), B.TRUE if c in inner else B.disj(*(self.reach(c, n) for n in inner if n != c))) for p in self.paths for c in self.colliders(p)))
        forbidden = B.disj(*(self.reach(u.exposure, n) for n in inner))
        direct = self.edge(u.exposure, u.outcome)
        out = {"adjustment_identifiable": self.identifiable, "empty_adjustment_valid": self.valid[none], "open_backdoor_under_empty": B.neg(self.valid[none]) if self.paths else B.FALSE, "direct_effect_edge_present": direct, "collider_activation_risk": collider, "forbidden_adjustment_risk": forbidden}
        speak = (B.variables(collider) | B.variables(forbidden)) - B.variables(direct)
        for v in sorted(speak, key=lambda v: (v not in prefer, self.u.names.index(v)))[:projections]:
            out[f"query_edge_{v.removeprefix('e__')}_present"] = B.var(v)
        by_size: dict[int, tuple] = {}
        for z, f in self.valid.items():
            by_size[len(z)] = B.disj(by_size.get(len(z), B.FALSE), f)
        smaller, buckets = B.FALSE, {}
        for k in sorted(by_size):
            key = str(k) if k < 3 else "3_or_more"
            buckets[key] = B.disj(buckets.get(key, B.FALSE), B.conj(by_size[k], B.neg(smaller)))
            smaller = B.disj(smaller, by_size[k])
        out |= {f"min_adjustment_size_is_{k}": f for k, f in buckets.items()}
        return dict([x for x in out.items() if x[1] != B.FALSE][:most])


def constraints(u: Universe, present=(), absent=(), gone_nodes=(), most_edges: int | None = None) -> tuple[tuple, int | None]:
    """A formula of fixed, present and absent edges and absent nodes; a bound on the number of edges goes beside it."""
    f = [u.edge(*e) for e in {*u.fixed, *present}] + [B.neg(u.edge(*e)) for e in absent] + [B.neg(u.edge(*e)) for e in u.edges if set(e) & set(gone_nodes)]
    return B.conj(*f), most_edges


def of_statuses(u: Universe, claims: list[dict]) -> tuple:
    """A formula of claims (comp_id, status): causal edges are there, non-causal ones are not; all others stay open."""
    of = {"causal": lambda f: f, "non-causal": B.neg}
    return B.conj(*(of[c["status"]](u.edge(*u.components[c["comp_id"]])) for c in claims if c.get("status") in of and c.get("comp_id") in u.components))


def of_graph(u: Universe, edges: list[tuple[str, str]], unmentioned: str = "non-causal") -> tuple:
    """A formula of a graph's edges and the fixed ones; edges not mentioned are ``non-causal`` or ``unknown``."""
    if unmentioned not in ("non-causal", "unknown"):
        raise CausalError("unmentioned edges are non-causal or unknown", "INVALID_CONSTRAINT")
    listed = {tuple(e) for e in edges} | u.fixed
    return B.conj(*(u.edge(*e) if e in listed else B.neg(u.edge(*e)) for e in u.edges if e in listed or unmentioned == "non-causal"))


def sparse(u: Universe, most_edges: int | None = None, most_into: int | None = None, most_out: int | None = None) -> tuple:
    """A formula that bounds the edges, all in all and into and out of each node."""
    f = [] if most_edges is None else [B.at_most(most_edges, u.names)]
    for k, end in ((most_out, 0), (most_into, 1)):
        if k is not None:
            f += [B.at_most(k, [name(e) for e in u.edges if e[end] == n]) for n in u.nodes]
    return B.conj(*f)


@dataclass
class Space:
    """Assignments that meet a constraint: words of bits in the columns a0, a1 ..; what is settled; the bit of each free variable; whether all are there."""

    df: DataFrame
    known: dict[str, bool]
    bit: dict[str, int]
    exact: bool
    rest: tuple

    def on(self, variable: str) -> Column:
        if variable in self.known:
            return F.lit(self.known[variable])
        i = self.bit[variable]
        return F.shiftright(f"a{i // WORD}", i % WORD).bitwiseAND(F.lit(1)) == 1

    def column(self, f: tuple) -> Column:
        return B.column(B.settle(f, self.known), self.on)

    @property
    def words(self) -> list[str]:
        return [f"a{i}" for i in range(max(1, -(-len(self.bit) // WORD)))]


def settled(constraint: tuple) -> tuple[dict[str, bool], tuple]:
    """What a constraint says outright, and what is left of it."""
    known: dict[str, bool] = {}
    rest = constraint
    while (new := B.literals(rest)) and not new.items() <= known.items():
        known |= new
        rest = B.settle(rest, known)
    return known, rest


def space(spark: SparkSession, u: Universe, constraint: tuple, most_edges: int | None = None, samples: int = SAMPLES, seed: int = 42, most_free: int = MOST_FREE, trials: int = 1, most_nodes: int = NODES) -> Space:
    """All assignments, or beyond ``most_free`` open variables ``samples`` even draws of those that meet the constraint.

    Draws walk down a counted decision diagram, each by itself, so equal ones may come more than once. Where the diagram has more than
    ``most_nodes`` nodes, ``trials`` hashed draws a sample are made and those that meet the constraint are kept.
    """
    known, rest = settled(B.conj(constraint, sparse(u, most_edges)))
    free = [n for n in u.names if n not in known]
    exact = len(free) <= most_free
    s = Space(None, known, {n: i for i, n in enumerate(free)}, exact, rest)
    if exact:
        parts = max(1, min(200, (1 << len(free)) >> 16))
        df = spark.range(0, 1 << len(free), 1, parts).withColumnRenamed("id", "a0")
    elif (df := _even(spark, u, rest, s, samples, seed, most_nodes)) is not None:
        s.df = df
        return s
    else:  # each word by a hash of its own
        df = spark.range(0, samples * trials, 1, 8).select(*(F.xxhash64(F.lit(seed), "id", F.lit(i)).bitwiseAND(F.lit((1 << min(WORD, len(free) - WORD * i)) - 1)).alias(w) for i, w in enumerate(s.words)))
    s.df = df.where(B.column(rest, s.on))
    return s


def _even(spark: SparkSession, u: Universe, rest: tuple, s: Space, samples: int, seed: int, most_nodes: int) -> DataFrame | None:
    """Even draws of assignments as words; None where the diagram is too large. Tasks share the diagram, which ``most_nodes`` bounds."""
    order = [n for n in variable_order(u) if n in s.bit]
    d = B.Diagram(order, most_nodes)
    try:
        root = d.of(rest)
    except B.TooLarge:
        return None
    words = s.words
    if not root:
        return spark.createDataFrame([], ", ".join(f"{w} long" for w in words))
    d.count(root)
    d._met.clear()
    held, to = spark.sparkContext.broadcast((d, root)), [s.bit[n] for n in order]

    def run(batches):
        known, f = held.value
        for x in batches:
            out = [[] for _ in words]
            for draw in x.column(0).to_pylist():
                bits = known.drawn(f, seed, draw)
                own = [0] * len(words)
                for i, b in enumerate(to):
                    if bits >> i & 1:
                        own[b // WORD] |= 1 << b % WORD
                for col, v in zip(out, own, strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], words)

    return spark.range(0, samples, 1, 8).mapInArrow(run, ", ".join(f"{w} long" for w in words))


def decoded(s: Space, u: Universe) -> DataFrame:
    """(a0 .., edges, nodes): each assignment's edges, and the nodes at their ends with exposure and outcome."""
    pair = lambda e: F.struct(F.lit(e[0]).alias("source"), F.lit(e[1]).alias("target"))
    edges = F.array_compact(F.array(*(F.when(s.on(name(e)), pair(e)) for e in u.edges)))
    ends = F.array_union(F.transform("edges", lambda e: e["source"]), F.transform("edges", lambda e: e["target"]))
    return s.df.select(*s.words, edges.alias("edges")).withColumn("nodes", F.array_sort(F.array_union(ends, F.array(F.lit(u.exposure), F.lit(u.outcome)))))


def sample(spark: SparkSession, u: Universe, constraint: tuple, n: int, seed: int = 42, trials: int = 50, **options) -> DataFrame:
    """``n`` assignments that meet the constraint, decoded: the first by hash of all of them or, where they are too many to list, ``n`` even draws (see ``space``)."""
    s = space(spark, u, constraint, samples=n, seed=seed, trials=trials, **options)
    return decoded(s, u).orderBy(F.xxhash64(F.lit(seed), *s.words), *s.words).limit(n)


def count(u: Universe, f: tuple, constraint: tuple = B.TRUE, most_nodes: int | None = NODES) -> int:
    """How many assignments of all variables meet both formulas, by a decision diagram."""
    known, rest = settled(B.conj(f, constraint))
    return B.models(rest, [n for n in variable_order(u) if n not in known], most_nodes)


def satisfiable(u: Universe, f: tuple, constraint: tuple = B.TRUE, most_nodes: int | None = NODES) -> bool:
    known, rest = settled(B.conj(f, constraint))
    return B.satisfiable(rest, [n for n in variable_order(u) if n not in known], most_nodes)


def _keyed(s: Space, atoms: dict[str, tuple]) -> DataFrame:
    return s.df.select(*s.words, *(s.column(f).alias(n) for n, f in atoms.items()))


def _by_diagram(u: Universe, rest: tuple, known: dict[str, bool], atoms: dict[str, tuple], most_nodes: int) -> list[tuple]:
    """(mass, atoms' values) of every class that isn't empty: atoms are added one by one in one diagram, and branches without assignments dropped."""
    d = B.Diagram([n for n in variable_order(u) if n not in known], most_nodes)
    found = [(d.of(rest), ())]
    for f in atoms.values():
        own = d.of(B.settle(f, known))
        found = [(g, (*values, v)) for n, values in found for g, v in ((d.both(n, own), True), (d.both(n, d.negation(own)), False)) if g]
    return [(d.count(n), *values) for n, values in found]


def query_classes(spark: SparkSession, u: Universe, constraint: tuple, most_edges: int | None = None, most_atoms: int = ATOMS, index: Index | None = None, most_nodes: int = NODES, mode: str = "auto", **options) -> DataFrame:
    """(class_id, mass, proportion, exact, and each atom's value); a class is named by its atoms' values as bits, plus one.

    ``mode``: auto (all assignments, or a sample where they are too many to list), full (exact: where they are too many to list, by
    decision diagrams as long as these stay small) or sampled.
    """
    if mode not in ("auto", "full", "sampled"):
        raise CausalError(f"no mode {mode}", "INVALID_MODE")
    s = space(spark, u, constraint, most_edges, **(options if mode != "sampled" else options | {"most_free": 0}))
    atoms = (index or Index(u)).atoms(most_atoms, set(s.bit))
    names = list(atoms)
    c, exact = None, s.exact
    if not exact and mode == "full":
        try:
            rows = _by_diagram(u, s.rest, s.known, atoms, most_nodes)
            # masses may be beyond 64 bits, and beyond 38 digits only their sizes are told
            kind, of = ("decimal(38,0)", Decimal) if sum(r[0] for r in rows) < 10**38 else ("double", float)
            c, exact = spark.createDataFrame([(of(r[0]), *r[1:]) for r in rows], f"mass {kind}" + "".join(f", `{n}` boolean" for n in names)), True
        except B.TooLarge:
            pass
    if c is None:
        c = _keyed(s, atoms).groupBy(*names).agg(F.count("*").alias("mass"))
    number = sum((F.col(n).cast("long") * F.lit(1 << i) for i, n in enumerate(names)), F.lit(1))
    total = c.agg(F.sum("mass").alias("total"))
    return c.crossJoin(F.broadcast(total)).select(F.format_string("Q%04d", number).alias("class_id"), "mass", (F.col("mass").cast("double") / F.col("total").cast("double")).alias("proportion"), F.lit(exact).alias("exact"), *names)  # one row is broadcast


def shape(classes: DataFrame) -> DataFrame:
    """Classes, mass, Shannon entropy (bits), concentration and the largest share."""
    p = F.col("proportion")
    return classes.agg(F.count("*").alias("classes"), F.sum("mass").alias("mass"), F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"), F.sum(p * p).alias("concentration"), F.max(p).alias("dominant"))


def crux(spark: SparkSession, u: Universe, constraint: tuple, top_k: int = 10, most_atoms: int = ATOMS, index: Index | None = None, **options) -> DataFrame:
    """For each open edge: the classes' entropy now, and if it were present or absent; ordered by the larger fall."""
    s = space(spark, u, constraint, **options)
    bit, exact = s.bit, s.exact
    atoms = (index or Index(u)).atoms(most_atoms, set(bit))
    if not bit:
        return spark.createDataFrame([], "component_id string, baseline_entropy double, entropy_if_present double, entropy_if_absent double, delta_u double, best_resolution string, rank int")
    names = list(atoms)
    keyed = _keyed(s, atoms).select(F.struct(*names).alias("k"), F.explode(F.array(*(F.struct(F.lit(n).alias("edge"), s.on(n).alias("on")) for n in bit))).alias("e"))
    counts = keyed.groupBy("e.edge", "e.on", "k").agg(F.count("*").alias("n"))

    def entropy(rows: DataFrame, *by: str) -> DataFrame:
        t = rows.groupBy(*by).agg(F.sum("n").alias("t"))
        p = F.col("n") / F.col("t")
        return rows.join(t, list(by)).groupBy(*by).agg(F.bround(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)), 12).alias("h"))

    base = entropy(counts.groupBy("edge", "k").agg(F.sum("n").alias("n")), "edge").withColumnRenamed("h", "baseline_entropy")
    each = entropy(counts, "edge", "on").groupBy("edge").agg(F.max(F.when(F.col("on"), F.col("h"))).alias("entropy_if_present"), F.max(F.when(~F.col("on"), F.col("h"))).alias("entropy_if_absent"))
    pos, neg = F.col("baseline_entropy") - F.coalesce("entropy_if_present", "baseline_entropy"), F.col("baseline_entropy") - F.coalesce("entropy_if_absent", "baseline_entropy")
    from pyspark.sql import Window

    place = F.create_map(*(F.lit(x) for kv in bit.items() for x in kv))
    out = base.join(each, "edge").select(F.col("edge").alias("component_id"), "baseline_entropy", "entropy_if_present", "entropy_if_absent", F.bround(F.greatest(pos, neg, F.lit(0.0)), 6).alias("delta_u"), F.when(pos >= neg, "present").otherwise("absent").alias("best_resolution"), F.lit(exact).alias("exact"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("delta_u"), place[F.col("component_id")]))).where(F.col("rank") <= top_k)  # one row an edge


def signature(spark: SparkSession, u: Universe, constraint: tuple, index: Index | None = None, **options) -> DataFrame:
    """One row: mass, whether the effect may be and must be identifiable, the mass and share where it is, whether no adjustment may do, and the sets that always and sometimes do."""
    index = index or Index(u)
    s = space(spark, u, constraint, **options)
    sets = sorted(index.valid, key=lambda z: (len(z), sorted(z)))
    ok = s.column(index.identifiable)
    rows = s.df.select(ok.alias("ok"), *(s.column(index.valid[z]).alias(f"z{i}") for i, z in enumerate(sets)))
    listed = lambda how: F.array_compact(F.array(*(F.when(how(f"z{i}"), F.array(*map(F.lit, sorted(z))).cast("array<string>")) for i, z in enumerate(sets))))
    out = rows.agg(
        F.count("*").alias("mass"), F.coalesce(F.bool_or("ok"), F.lit(False)).alias("possibly_identifiable"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("necessarily_identifiable"),
        F.count_if("ok").alias("identifiable_mass"), F.coalesce(F.bool_or("z0"), F.lit(False)).alias("empty_adjustment_valid"), listed(F.bool_and).alias("always_valid_sets"), listed(F.bool_or).alias("sometimes_valid_sets"), F.lit(s.exact).alias("exact"),
    )
    return out.withColumn("proportion", F.try_divide("identifiable_mass", "mass"))


def compare(spark: SparkSession, u: Universe, one: tuple, other: tuple, **options) -> DataFrame:
    """The query's signature under two constraints, and whether both say the same of identifiability."""
    index = Index(u)
    a, b = (signature(spark, u, c, index, **options).withColumn("side", F.lit(label)) for label, c in (("one", one), ("other", other)))
    both = a.unionByName(b)
    agree = both.agg((F.count_distinct("possibly_identifiable") == 1).alias("compatible"))
    return both.crossJoin(F.broadcast(agree))  # one row is broadcast


def preferred(spark: SparkSession, u: Universe, own: tuple, multiverse: tuple = B.TRUE, **options) -> tuple[DataFrame, DataFrame]:
    """A preferred hypothesis's signature with the share of the multiverse that agrees with it on identifiability, and the multiverse's classes."""
    index = Index(u)
    mine = signature(spark, u, own, index, **options)
    whole = signature(spark, u, multiverse, index, **options).select(F.col("proportion").alias("_p"))
    share = F.when(F.col("necessarily_identifiable"), F.col("_p")).when(~F.col("possibly_identifiable"), 1 - F.col("_p"))
    return mine.crossJoin(F.broadcast(whole)).withColumn("agreeing_share", share).drop("_p"), query_classes(spark, u, multiverse, index=index, **options)  # one row is broadcast


#: The nodes of the two templates in order of time, and the edges that are always there: fixed values.
TEMPLATES = {"paper_small": ["A", "X", "B", "C", "D", "Y"], "paper_13": ["A", "S1", "X", "S2", "B", "S3", "C", "S4", "D", "S5", "S6", "S7", "Y"]}
ALWAYS = {("A", "X"), ("A", "C"), ("B", "C"), ("B", "Y"), ("X", "Y")}
#: Paths of the large template that are looked at.
MOST_PATHS = {"paper_small": None, "paper_13": 256}


def template(size: str = "paper_small") -> Universe:
    if size not in TEMPLATES:
        raise CausalError(f"no template {size}", "INVALID_SCENARIO")
    u = from_nodes([{"name": n, "timing": i} for i, n in enumerate(TEMPLATES[size])], "X", "Y")
    u.fixed = set(ALWAYS)
    return u


def paper_small() -> Universe:
    return template()


def _case(which: str, size: str, unknown):
    if which not in ("illusion", "lynchpin", "ghost"):
        raise CausalError(f"no scenario {which}", "INVALID_SCENARIO")
    u = template(size)
    unknown = unknown or ([("C", "D"), ("X", "C")] if which == "illusion" else [("C", "D")])
    c, _ = constraints(u, absent=[e for e in u.edges if e not in u.fixed and e not in unknown])
    return u, c, unknown, Index(u, most_paths=MOST_PATHS[size], known=settled(c)[0] if size != "paper_small" else None)


def scenario(spark: SparkSession, which: str, unknown: list[tuple[str, str]] | None = None, size: str = "paper_small") -> tuple[DataFrame, DataFrame]:
    """Classes and their shape for illusion, lynchpin or ghost: all other edges are absent, the unknown ones open."""
    u, c, _, index = _case(which, size, unknown)
    found = durable(query_classes(spark, u, c, most_atoms=8, index=index))
    return found, shape(found)


def scenario_metrics(spark: SparkSession, which: str, unknown: list[tuple[str, str]] | None = None, size: str = "paper_small", far: float = 0.3) -> dict:
    """What a scenario is to show. Illusion: how much more hypotheses agree on edges than on the query; lynchpin: how far settling
    the edge lowers the entropy; ghost: classes that hypotheses without the edge hardly share."""
    u, c, open_, index = _case(which, size, unknown)
    found, shaped = scenario(spark, which, unknown, size)
    r = shaped.first()
    if which == "illusion":
        agreed = 1 - len(open_) / len(u.edges)
        return {"surface_structural_consensus": round(agreed, 4), "query_class_entropy": round(r["entropy"], 4), "dominant_class_share": round(r["dominant"], 4), "causal_compatibility": round(r["concentration"], 4), "consensus_gap": round(agreed - r["concentration"], 4), "classes_count": r["classes"]}
    if which == "lynchpin":
        edge = open_[0]
        ranked = crux(spark, u, c, most_atoms=8, index=index).where(F.col("component_id") == name(edge)).first()
        gain = ranked["delta_u"] if ranked else 0.0
        return {"baseline_entropy": round(r["entropy"], 4), "post_resolution_expected_entropy": round(r["entropy"] - gain, 4), "phase_transition_score": round(gain, 4), "lynchpin_rank": ranked["rank"] if ranked else 0, "lynchpin_edge": list(edge)}
    s = space(spark, u, c)
    atoms = index.atoms(8, set(s.bit))
    own = _keyed(s, atoms).withColumn("main", ~s.on(name(open_[0])))  # hypotheses without the edge are the mainstream
    per = own.groupBy(*atoms).agg(F.count("*").alias("mass"), F.avg(F.col("main").cast("double")).alias("overlap")).where(F.col("overlap") <= far)
    g = per.agg(F.count("*").alias("n"), F.coalesce(F.sum("mass"), F.lit(0)).alias("mass"), F.max(F.struct("mass", "overlap")).alias("top")).first()
    return {"classes_detected": r["classes"], "ghost_class_count": g["n"], "ghost_total_mass": float(g["mass"]), "largest_ghost_mass": float(g["top"]["mass"]) if g["top"] else 0.0, "largest_ghost_prior_overlap": g["top"]["overlap"] if g["top"] else 1.0, "ghost_internal_coherence": 1.0 if g["top"] else 0.0}
