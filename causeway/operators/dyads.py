"""Ordered pairs of models, compared claim by claim on packed sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.errors import DyadError
from causeway.functions import bits
from causeway.functions.durable import number_rows
from causeway.operators import models as M
from causeway.sources.registry import Registry

#: Models are broadcast only up to this many bytes; more are compared block by block by Spark's own cross product.
BROADCAST_BYTES = 64 << 20
#: Alters of a tile, tasks that tiles are dealt to at most, and pairs of a task at least, if there are as many.
TILE, MOST_TASKS, PAIRS = 128, 20_000, 1 << 20


def pairs(models: DataFrame, registry: Registry, others: DataFrame | None = None, itself: bool = False, size: int | None = None) -> DataFrame:
    """All ordered pairs: columns of the ego with prefix ``e_``, of the alter with ``a_``. ``size``: rows of ``others``, if known.

    Alters lie in tiles of those that claim alike, and a tile is taken against one ego after another: ids and counts repeat at short
    distance, so that files of pairs stay small, and tasks grow with one side alone. Where both sides may be broadcast, a task is a range of
    (tile, ego) that looks up both, all in generated code. A join's loop keeps all that one row meets until it is read, so no row meets more than a tile.
    """
    own = others is None
    others = models if own else others
    size = others.count() if size is None else size
    claims = [f"{k}{i}" for k in ("np", "app", "cm", "xm") for i in range(registry.words)]
    placed = number_rows(others, *claims, "model_id", name="_place")
    numbered = placed if own else number_rows(models, *claims, "model_id", name="_place")
    egos = size if own else numbered.count()
    e = [F.col(c).alias(f"e_{c}") for c in models.columns]
    a = [F.col(c).alias(f"a_{c}") for c in others.columns]
    most = BROADCAST_BYTES // (64 + 32 * registry.words + 8 * len(registry.nodes))
    tile, tiles = F.floor((F.col("_place") - 1) / TILE).alias("_tile"), -(-size // TILE)
    tasks = max(1, min(tiles, MOST_TASKS, -(-size * max(egos, 16) // PAIRS)))
    by_place = F.broadcast(numbered.select((F.col("_place") - 1).alias("_ego"), *e)) if egos <= most else None
    names = [f"e_{c}" for c in models.columns]
    if max(egos, size) <= most:
        places = models.sparkSession.range(0, tiles * egos, 1, tasks).select(F.expr(f"id div {max(egos, 1)}").alias("_tile"), F.expr(f"id % {max(egos, 1)}").alias("_ego"))
        out = places.join(by_place, "_ego").join(F.broadcast(placed.select(tile, *a)), "_tile").drop("_tile", "_ego")
    else:
        tiled = placed.withColumn("_tile", tile).repartition(tasks, "_tile")
        tiled = tiled.groupBy("_tile").agg(F.array_sort(F.collect_list(F.struct("_place", *a))).alias("_own"))
        if by_place is None:
            met = tiled.select("_own").crossJoin(numbered.select(*e))
        else:  # the numbers of the egos, not made beforehand as a constant
            met = tiled.select("_own", F.explode(F.sequence(F.lit(0).cast("long"), F.size("_own") * 0 + F.lit(egos).cast("long"))).alias("_ego")).join(by_place, "_ego")
        out = met.select(*names, F.inline("_own")).drop("_place")
    return out if itself else out.where("e_model_id <> a_model_id")


def _both(registry: Registry, left: str = "e_", right: str = "a_") -> dict[str, tuple[list[Column], list[Column]]]:
    return {k: (bits.words(k, registry.words, left), bits.words(k, registry.words, right)) for k in ("np", "app", "cm", "xm")}


def counters(registry: Registry, left: str = "e_", right: str = "a_") -> dict[str, Column]:
    """The counts of a pair by the table of compared claims."""
    s = _both(registry, left, right)
    meet = lambda k: bits.each(lambda x, y: x.bitwiseAND(y), *s[k])
    join = lambda k: bits.each(lambda x, y: x.bitwiseOR(y), *s[k])
    differ = lambda k: bits.each(lambda x, y: x.bitwiseXOR(y), *s[k])
    both_apply = meet("app")
    agree = bits.each(lambda c, x: c.bitwiseOR(x), meet("cm"), meet("xm"))
    clash = edge_conflicts(registry, left, right)
    claimed = bits.each(lambda c, x, a: c.bitwiseOR(x).bitwiseAND(a), join("cm"), join("xm"), both_apply)
    moved = bits.each(lambda c, x, a: c.bitwiseOR(x).bitwiseAND(a), differ("cm"), differ("xm"), both_apply)
    one_side = bits.count(differ("app"))
    return {
        "shared": bits.count(meet("np")) + bits.count(agree),
        "union_claims": bits.count(join("np")) + bits.count(claimed) + bits.count(clash) + one_side,
        "repair_cost": bits.count(differ("np")) + one_side + bits.count(moved),
        "node_conflicts": bits.count(differ("np")),
        "edge_conflicts": bits.count(clash),
        "inapplicable_components": F.lit(len(registry.edges)) - bits.count(both_apply),
        "compared": bits.count(join("np")) + bits.count(claimed) + one_side,
    }


def edge_conflicts(registry: Registry, left: str = "e_", right: str = "a_") -> list[Column]:
    s = _both(registry, left, right)
    return [c.bitwiseAND(y).bitwiseOR(x.bitwiseAND(d)) for (c, d), (x, y) in zip(zip(*s["cm"], strict=True), zip(*s["xm"], strict=True), strict=True)]


def similarity(shared: Column, union: Column) -> Column:
    return F.when(union == 0, 1.0).otherwise(shared / union)


def _names(rows: list[dict], registry: Registry) -> list[tuple[int, str]]:
    return [(registry.ordinal[r["comp_id"]], r["comp_id"]) for r in rows]


def timing_compatible(registry: Registry) -> Column:
    """No backward causal edge in either model, and no shared node with two known times that differ."""
    clash = F.lit(False)
    nodes = [(registry.ordinal[r["comp_id"]], i) for i, r in enumerate(registry.nodes)]
    e, a = bits.words("np", registry.words, "e_"), bits.words("np", registry.words, "a_")
    for b, i in nodes:
        differ = F.get("e_timing", F.lit(i)) != F.get("a_timing", F.lit(i))
        clash = clash | (bits.has(e, b) & bits.has(a, b) & F.coalesce(differ, F.lit(False)))
    return ~F.col("e_backward") & ~F.col("a_backward") & ~clash


def compare(pairs_: DataFrame, registry: Registry, rounded: bool = True, text: bool = False) -> DataFrame:
    """The full structural record of each pair. The models need the column ``backward`` (see ``timed``). ``text``: lists of components as strings, with commas."""
    c = counters(registry)
    rate = similarity(F.col("shared"), F.col("union_claims"))
    clashes = (edge_conflicts(registry), _names(registry.edges, registry))
    nodes = (bits.each(lambda x, y: x.bitwiseXOR(y), *_both(registry)["np"]), _names(registry.nodes, registry))
    lost = (bits.each(lambda x, y: F.bitwise_not(x.bitwiseAND(y)), *_both(registry)["app"]), _names(registry.edges, registry))
    # names are made only for pairs that have any
    some = lambda n, names: F.when(n > 0, names).otherwise(F.lit("") if text else F.array().cast("array<string>"))
    conflicts = some(c["edge_conflicts"] + c["node_conflicts"], bits.joined(clashes, nodes) if text else F.concat(bits.members(*clashes), bits.members(*nodes)))
    apart = some(c["inapplicable_components"], bits.joined(lost) if text else bits.members(*lost))
    out = pairs_.select(
        F.col("e_model_id").alias("ego_id"), F.col("a_model_id").alias("alter_id"), *(v.cast("bigint").alias(k) for k, v in c.items() if k != "compared"),
        timing_compatible(registry).alias("timing_compatible"), conflicts.alias("conflicting_components"), apart.alias("excluded_components"),
    )
    return out.select(
        F.concat_ws("__", "ego_id", "alter_id").alias("dyad_id"), "ego_id", "alter_id", (F.bround(rate, 6) if rounded else rate).alias("similarity_rate"), "timing_compatible",
        (F.col("edge_conflicts") + F.col("node_conflicts") > 0).alias("existence_conflict"), "conflicting_components", "repair_cost", "excluded_components", "node_conflicts", "edge_conflicts", "inapplicable_components",
        F.col("shared").alias("shared_resolved_claims"), F.col("union_claims").alias("union_resolved_claims"),
    )


def timed(models: DataFrame, registry: Registry) -> DataFrame:
    return models.withColumn("backward", F.size(M.backward_edges(registry)) > 0)


def counts(pairs_: DataFrame, registry: Registry) -> DataFrame:
    """Just ids and counters."""
    return pairs_.select(F.col("e_model_id").alias("ego_id"), F.col("a_model_id").alias("alter_id"), *(v.cast("bigint").alias(k) for k, v in counters(registry).items()))


def all_pairs(models: DataFrame, registry: Registry, text: bool = False, **options) -> DataFrame:
    return compare(pairs(timed(models, registry), registry, **options), registry, text=text)


def single_reference(models: DataFrame, registry: Registry, reference: str) -> DataFrame:
    """The reference as ego against all others."""
    m = timed(models, registry)
    one = m.where(F.col("model_id") == reference)
    if not one.limit(1).count():
        raise DyadError(f"no model {reference}", "INVALID_REFERENCE")
    e = one.select(*(F.col(c).alias(f"e_{c}") for c in m.columns))
    a = m.select(*(F.col(c).alias(f"a_{c}") for c in m.columns))
    return compare(a.crossJoin(F.broadcast(e)).where("e_model_id <> a_model_id"), registry)  # one row is broadcast


def touching(models: DataFrame, registry: Registry, changed: DataFrame) -> DataFrame:
    """Pairs of which either side is in ``changed`` (model_id): each once."""
    m = timed(models, registry)
    new = m.join(changed.select("model_id").distinct(), "model_id", "left_semi")
    old = m.join(changed.select("model_id").distinct(), "model_id", "left_anti")
    return compare(pairs(new, registry, m), registry).unionByName(compare(pairs(old, registry, new), registry))


def two_stage(models: DataFrame, registry: Registry, top_k: int = 100) -> DataFrame:
    """The most similar pairs, ties by ids: ranked on counts of those pairs that bounds leave open (``closest``), the full record of the first alone."""
    if top_k <= 0:
        raise DyadError("top_k must be positive", "INVALID_TOP_K")
    from causeway.operators.closest import most_similar

    m = timed(models, registry)
    top, _ = most_similar(models, registry, top_k)
    top = F.broadcast(top)  # top_k rows
    side = lambda p: m.select(*(F.col(c).alias(f"{p}{c}") for c in m.columns))
    e = side("e_").join(top, F.col("e_model_id") == F.col("ego_id"))
    return compare(side("a_").join(F.broadcast(e), F.col("a_model_id") == F.col("alter_id")).drop("ego_id", "alter_id"), registry)
