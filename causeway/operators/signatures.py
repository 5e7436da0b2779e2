"""Completions of partial models: every valid way to settle their unknown edges, matched to models by signature.

How many completions a model has, and how many of them are there, is counted (``coverage``): a partial signature is a pattern, and the
resolved models that fit it agree with it outside its open edges. Only what lists completions is bound by how many there are.
"""

from __future__ import annotations

from decimal import Decimal
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.errors import StateError
from causeway.functions import bits
from causeway.functions.durable import durable, number_rows
from causeway.functions.graphs import Graph, bits_of, reach
from causeway.operators import models as M
from causeway.sources.registry import Registry

#: Open edges of a model whose completions are listed.
MOST_UNKNOWN = 16
#: Nodes that lie on circles with each other, for counting ways without a circle: the work is three to this power.
MOST_ON_CIRCLES = 14
#: Counts are decimals of 38 digits; 2 to the power of 126 is the last power of two that fits.
_POWERS = 126


class Checker:
    """Whether a packed model is valid: fixed edges causal, no backward causal edge, no directed cycle."""

    def __init__(self, registry: Registry):
        self.nodes = {r["comp_id"]: i for i, r in enumerate(registry.nodes)}
        self.n = len(registry.nodes)
        self.directed = [(registry.ordinal[r["comp_id"]], *(self.nodes[x] for x in registry.ends(r["comp_id"]))) for r in registry.edges if r["direction"] == "->"]
        self.fixed = sum(1 << registry.ordinal[r["comp_id"]] for r in registry.edges if r["fixed_status"] == "causal")

    def valid(self, causal: int, timing: list) -> bool:
        if self.fixed & ~causal:
            return False
        edges = [(s, t) for b, s, t in self.directed if causal >> b & 1]
        if any(timing[s] is not None and timing[t] is not None and timing[s] >= timing[t] for s, t in edges):
            return False
        return Graph(self.n, set(edges)).acyclic()


def to_int(words: list[int]) -> int:
    return sum((w & (1 << 64) - 1) << 64 * i for i, w in enumerate(words))


def to_words(x: int, n: int) -> list[int]:
    return [bits.signed(x >> 64 * i & (1 << 64) - 1) for i in range(n)]


def completions(models: DataFrame, registry: Registry, most: int = MOST_UNKNOWN) -> DataFrame:
    """(model_id, np*, app*, cm*, xm*, timing): the valid completions of each model; a resolved valid model is its own."""
    n, check = registry.words, Checker(registry)
    packed = models.select("model_id", *(f"{k}{i}" for k in ("np", "app", "cm", "xm") for i in range(n)), "timing")

    def run(batches):
        for x in batches:
            cols = x.to_pydict()
            out = {name: [] for name in x.schema.names}
            for r in range(len(x)):
                app, cm, xm = (to_int([cols[f"{k}{i}"][r] for i in range(n)]) for k in ("app", "cm", "xm"))
                open_ = bits_of(app & ~cm & ~xm)
                if len(open_) > most:
                    raise StateError(f"{cols['model_id'][r]} leaves {len(open_)} edges open; at most {most} can be settled")
                for pick in product((True, False), repeat=len(open_)):
                    c = cm | sum(1 << b for b, on in zip(open_, pick, strict=True) if on)
                    if check.valid(c, cols["timing"][r]):
                        row = {"model_id": cols["model_id"][r], "timing": cols["timing"][r]}
                        for k, v in (("cm", to_words(c, n)), ("xm", to_words(app & ~c, n))):
                            row |= {f"{k}{i}": w for i, w in enumerate(v)}
                        for name, col in out.items():
                            col.append(row[name] if name in row else cols[name][r])
            yield pa.RecordBatch.from_pydict(out, schema=x.schema)

    return packed.mapInArrow(run, packed.schema)


def resolved(models: DataFrame, registry: Registry) -> DataFrame:
    return models.where(~bits.any_set(M.unknown(registry)))


def matched(models: DataFrame, registry: Registry, among: DataFrame | None = None) -> DataFrame:
    """(model_id, sig, descendant): completions with the first resolved model of the same signature (``among`` these), null if there is none."""
    sig = M.signature(registry).alias("sig")
    done = resolved(models if among is None else among, registry).select(sig, F.col("model_id").alias("d")).groupBy("sig").agg(F.min("d").alias("descendant"))
    return completions(models, registry).select("model_id", sig).join(done, "sig", "left").select("model_id", "sig", "descendant")


def _directed(registry: Registry) -> list[tuple[int, int, int]]:
    """(bit, source, target) of the directed edges."""
    return Checker(registry).directed


def forbidden(registry: Registry) -> list[Column]:
    """The set of directed edges whose source isn't earlier than its target though the model knows both times."""
    out = [F.lit(0).cast("bigint")] * registry.words
    for bit, s, t in _directed(registry):
        late = F.coalesce(F.get("timing", F.lit(s)) >= F.get("timing", F.lit(t)), F.lit(False))
        out[bit >> 6] = out[bit >> 6].bitwiseOR(F.when(late, F.lit(bits.signed(1 << (bit & 63)))).otherwise(F.lit(0)).cast("bigint"))
    return out


def count_without_circles(n: int, required: set[tuple[int, int]], optional: list[tuple[int, int]]) -> int:
    """How many choices among the optional edges leave no circle, all required ones being there.

    Optional edges between nodes that no circle joins are free. Among nodes that circles may join, the choices are counted by their
    sets of sources: a set that may all be sources counts with a sign, as a graph is met once for each set of its sources.
    """
    every = Graph(n, required | set(optional))
    down = every.children()
    below = [reach(1 << i, down) for i in range(n)]
    same = [sum(1 << j for j in bits_of(below[i]) if below[j] >> i & 1) for i in range(n)]
    total = 1
    for a, b in optional:
        if not same[a] >> b & 1:
            total *= 2
    for group in {x for x in same if x & x - 1}:
        if group.bit_count() > MOST_ON_CIRCLES:
            raise StateError(f"{group.bit_count()} nodes may lie on circles; at most {MOST_ON_CIRCLES} can be counted")
        need, may = [0] * n, [0] * n
        for a, b in required:
            if group >> a & 1 and group >> b & 1:
                need[a] |= 1 << b
        for a, b in optional:
            if group >> a & 1 and group >> b & 1:
                may[a] |= 1 << b
        into = [sum(1 << a for a in bits_of(group) if need[a] >> b & 1) for b in range(n)]

        @lru_cache(None)
        def ways(left: int, need=need, may=may, into=into) -> int:
            if not left:
                return 1
            able = sum(1 << i for i in bits_of(left) if not into[i] & left)  # no required edge comes in
            out, top = 0, able
            while top:
                rest = left & ~top
                sign = 1 if top.bit_count() & 1 else -1
                out += sign * (1 << sum((may[i] & rest).bit_count() for i in bits_of(top))) * ways(rest)
                top = top - 1 & able
            return out

        total *= ways(group)
    return total


def _counted(patterns: DataFrame, registry: Registry) -> DataFrame:
    """``patterns`` (cm*, free*) of a registry whose edges may run in circles, each once, with how many settings of the free edges leave none."""
    n, directed = registry.words, _directed(registry)
    nodes = len(registry.nodes)

    def run(batches):
        for x in batches:
            cols = x.to_pydict()
            out = []
            for r in range(len(x)):
                cm, free = (to_int([cols[f"{k}{i}"][r] for i in range(n)]) for k in ("cm", "free"))
                required = {(s, t) for b, s, t in directed if cm >> b & 1}
                optional = [(s, t) for b, s, t in directed if free >> b & 1]
                ways = count_without_circles(nodes, required, optional) if Graph(nodes, required).acyclic() else 0
                ways <<= free.bit_count() - len(optional)  # edges without a direction are free
                out.append(Decimal(ways) if ways < 10**38 else None)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out, pa.decimal128(38, 0))], [*x.schema.names, "expected"])

    names = [f"{k}{i}" for k in ("cm", "free") for i in range(n)]
    return patterns.select(*names).distinct().mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", expected decimal(38,0)")


def coverage(models: DataFrame, registry: Registry, among: DataFrame | None = None) -> DataFrame:
    """(model_id, expected, represented): how many valid completions a model has (null from 39 digits on), and how many different ones the resolved models (``among`` these) are.

    Patterns of one set of nodes, times and open edges meet the resolved models of those nodes and times once, with the open edges masked out.
    """
    n = registry.words
    circles = not Graph(len(registry.nodes), {(s, t) for _, s, t in _directed(registry)}).acyclic()
    fixed = bits.literal([registry.ordinal[r["comp_id"]] for r in registry.edges if r["fixed_status"] == "causal"], n)
    words = lambda k: [f"{k}{i}" for i in range(n)]
    time = F.coalesce(F.to_json("timing"), F.lit("")).alias("time")
    none = lambda sets: ~bits.any_set(sets)

    def described(df: DataFrame) -> DataFrame:
        open_, late = M.unknown(registry), forbidden(registry)
        cm = bits.words("cm", n)
        valid = none(bits.each(lambda c, f: c.bitwiseAND(f), cm, late)) & none(bits.each(lambda c, o, x: F.bitwise_not(c.bitwiseOR(o)).bitwiseAND(F.lit(x)), cm, open_, fixed)) & none(bits.each(lambda o, f, x: o.bitwiseAND(f).bitwiseAND(F.lit(x)), open_, late, fixed))
        must = bits.each(lambda o, x: o.bitwiseAND(F.lit(x)), open_, fixed)
        free = bits.each(lambda o, f, x: o.bitwiseAND(F.bitwise_not(f)).bitwiseAND(F.bitwise_not(F.lit(x))), open_, late, fixed)
        named = [c.alias(x) for k, cols in (("open", open_), ("free", free), ("sure", bits.each(lambda c, m: c.bitwiseOR(m), cm, must))) for c, x in zip(cols, words(k), strict=True)]
        return df.select("model_id", *words("np"), *words("app"), *words("cm"), time, valid.alias("valid"), *named)

    own = described(models)
    power = F.array(*(F.lit(Decimal(2**i)).cast("decimal(38,0)") for i in range(_POWERS + 1)))
    if circles:
        ways = _counted(own.where("valid").select(*(F.col(a).alias(b) for a, b in zip(words("sure"), words("cm"), strict=True)), *words("free")), registry)
        ways = ways.select(*(F.col(a).alias(b) for a, b in zip(words("cm"), words("sure"), strict=True)), *words("free"), "expected")
        own = own.join(ways, [*words("sure"), *words("free")], "left")
    else:
        own = own.withColumn("expected", F.get(power, bits.count(bits.words("free", n)).cast("int")))
    own = durable(own.withColumn("expected", F.when(F.col("valid"), F.col("expected")).otherwise(F.lit(0).cast("decimal(38,0)"))))

    key = [*words("np"), *words("app"), "time"]
    done = described(resolved(models if among is None else among, registry)).where("valid").select(*key, *words("cm")).distinct()
    if circles:
        whole = _counted(done.select(*words("cm"), *(F.lit(0).cast("bigint").alias(x) for x in words("free"))), registry)
        done = done.join(whole.where("expected = 1").select(*words("cm")), words("cm"), "left_semi").select(*key, *words("cm"))
    masks = own.select(*key, *words("open")).distinct()
    masked = [c.bitwiseAND(F.bitwise_not(o)).alias(x) for c, o, x in zip(bits.words("cm", n), bits.words("open", n), words("cm"), strict=True)]
    fit = done.join(masks, key).select(*key, *words("open"), *masked).groupBy(*key, *words("open"), *words("cm")).agg(F.count("*").alias("represented"))
    return own.join(fit, [*key, *words("open"), *words("cm")], "left").select("model_id", "expected", F.when(F.col("valid"), F.coalesce("represented", F.lit(0))).otherwise(0).cast("bigint").alias("represented"))


def diagnostics(models: DataFrame, registry: Registry) -> DataFrame:
    """Per model: whether it is resolved, completions expected and there, whether all are, and how many others share its signature."""
    sig = models.select("model_id", M.signature(registry).alias("sig"), (~bits.any_set(M.unknown(registry))).alias("is_resolved"))
    twins = sig.groupBy("sig").agg((F.count("*") - 1).alias("duplicates"))
    out = sig.join(twins, "sig").join(coverage(models, registry), "model_id")
    complete = F.coalesce(F.col("expected") == F.col("represented"), F.lit(False)) & ~(F.col("is_resolved") & (F.col("expected") == 0))
    return out.select("model_id", "is_resolved", "expected", "represented", complete.alias("coverage_complete"), "duplicates")


def support(models: DataFrame, registry: Registry) -> DataFrame:
    """Packed models for the missing completions, named __support_ and a number in the order of their signatures."""
    sig = M.signature(registry)
    have = resolved(models, registry).select(sig.alias("sig"))
    c = completions(models, registry).drop("model_id").withColumn("sig", sig).dropDuplicates(["sig"])
    missing = c.join(have, "sig", "left_anti")
    names = [f"{k}{i}" for k in ("np", "app", "cm", "xm") for i in range(registry.words)]
    return number_rows(missing, "sig").select(F.format_string("__support_%06d", "n").alias("model_id"), *names, "timing")
