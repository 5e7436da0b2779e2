"""The older workflow: hypotheses around one test effect as edge tables, formula strings, adjustment sets and agreement with a reference.

Nodes are named Y (type otc), Xtest (test) and X1, X2, .. by time (ctr). Edges are rows (model, from, to, direction).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.errors import EngineError
from causeway.functions import graphs as G
from causeway.functions.durable import durable, number_rows

#: Optional edges whose every choice is listed.
MOST_OPTIONAL = 40


def roles(nodes: list[str], timing: list[int], types: list[str]) -> list[dict]:
    """(label, name, timing, type) of each node in order of time."""
    out, n = [], 0
    for label, t, kind in sorted(zip(nodes, timing, types, strict=True), key=lambda x: x[1]):
        n += kind == "ctr"
        out.append({"label": label, "name": {"otc": "Y", "test": "Xtest"}.get(kind) or f"X{n}", "timing": t, "type": kind})
    at = {r["name"]: r["timing"] for r in out}
    if not {"Y", "Xtest"} <= set(at) or at["Xtest"] >= at["Y"]:
        raise EngineError("one outcome and one test node are needed, and the test must come before the outcome")
    return out


def parse(models: list[str]) -> list[tuple[int, str, str, str]]:
    """(model, from, to, direction) of formulas like ``A ~ B + C; D ~~ E``."""
    out = []
    for k, text in enumerate(models, 1):
        for part in filter(str.strip, text.split(";")):
            arrow = "<->" if "~~" in part else "->"
            to, rest = (x.strip() for x in re.split("~~|~", part, maxsplit=1))
            if arrow == "<->":
                to, rest = rest, to
            out += [(k, s.strip(), to, arrow) for s in rest.split("+")]
    return out


def pair_grid(nodes: list[dict]) -> list[tuple[str, str, str]]:
    """(from, to, direction) of all pairs that time allows; both orientations of one time between controls."""
    out = []
    for a in nodes:
        for b in nodes:
            x, y = a["type"] != "otc", b["type"] != "otc"
            if a["name"] == b["name"]:
                out.append((a["name"], b["name"], "->"))
            elif (x and not y and a["timing"] <= b["timing"]) or (not x and b["type"] == "ctr" and a["timing"] <= b["timing"]) or (x and y and a["timing"] < b["timing"]):
                out.append((a["name"], b["name"], "->"))
            elif a["type"] == b["type"] == "ctr" and a["timing"] == b["timing"]:
                out.append((a["name"], b["name"], "<->"))
    return out


def build_causal_node(spark: SparkSession, nodes: list[str], timing: list[int], types: list[str], user_models: list[str] | None = None, include_subsets: bool = False) -> DataFrame:
    """All hypotheses as rows (model, from, to, direction, component, user_mod): every choice of the optional edges, the test effect always there.

    A node's edge to itself stands for the node alone and goes where another edge has it. Equal hypotheses count once and are
    numbered densely; user models that are among them are marked, the others added.
    """
    named = roles(nodes, timing, types)
    grid = pair_grid(named)
    must = [e for e in grid if e[:2] == ("Xtest", "Y") or (not include_subsets and e[0] == e[1] and e[0] not in ("Y", "Xtest"))]
    may = [e for e in grid if e not in must]
    row = lambda e: F.struct(F.lit(e[0]).alias("from"), F.lit(e[1]).alias("to"), F.lit(e[2]).alias("direction"))
    picked = F.array_compact(F.array(*(F.when(F.call_function("getbit", "id", F.lit(i)) == 1, row(e)) for i, e in enumerate(may)), *(row(e) for e in must)))
    pure = F.filter(picked, lambda e: (e["from"] != e["to"]) | ~F.exists(picked, lambda o: (o["from"] != o["to"]) & ((o["from"] == e["from"]) | (o["to"] == e["from"]))))
    if len(may) > MOST_OPTIONAL:
        raise EngineError(f"{len(may)} edges are optional; at most {MOST_OPTIONAL} can be listed in full")
    space = spark.range(0, 1 << len(may), 1, max(1, min(200, (1 << len(may)) >> 14)))
    first = space.select("id", F.array_sort(pure).alias("edges")).groupBy("edges").agg(F.min("id").alias("id"), F.lit(0).alias("user_mod"))
    if user_models:
        name = {r["label"]: r["name"] for r in named}
        own = spark.createDataFrame([(k, name[a], name[b], d) for k, a, b, d in parse(user_models)], "k int, from string, to string, direction string")
        own = own.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("from", "to", "direction"))).alias("edges")).groupBy("edges").agg(F.min("k").alias("k"))
        first = first.join(own, "edges", "full").select("edges", F.coalesce("id", F.lit(1 << 62) + F.col("k")).alias("id"), F.col("k").isNotNull().cast("int").alias("user_mod"))
    numbered = number_rows(first, "id", name="model").withColumn("model", F.col("model").cast("int"))  # ids are one number a hypothesis
    e = numbered.select("model", "user_mod", F.explode("edges").alias("e")).select("model", "e.*", "user_mod")
    return e.withColumn("component", F.when(F.col("from") == F.col("to"), F.col("from")).otherwise(F.concat_ws("_", "from", "to")))


def formulas(edges: DataFrame) -> DataFrame:
    """(model, formula): one formula for each caused node, Y before the others, then the two-sided ones."""
    directed = edges.where("direction = '->'").groupBy("model", "to").agg(F.concat(F.first("to"), F.lit(" ~ "), F.array_join(F.array_sort(F.collect_list("from")), " + ")).alias("f"))
    order = F.when(F.col("to").startswith("Y"), 1).when(F.col("to").startswith("M"), 2).otherwise(3)
    rows = directed.select("model", order.alias("o"), "f").union(edges.where("direction = '<->'").select("model", F.lit(4), F.concat_ws(" ~~ ", "to", "from")))
    return rows.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "f"))), lambda x: x["f"]), ", ").alias("formula"))


def adjustment(edges: DataFrame, names: list[str], effect: str = "direct") -> DataFrame:
    """(model, mas): minimal sets for the effect of Xtest on Y. Direct: sets of all other nodes that part the two once their edge is gone."""
    at = {n: i for i, n in enumerate(names)}

    def run(t):
        import pyarrow as pa

        rows = list(zip(t.column("from").to_pylist(), t.column("to").to_pylist(), t.column("direction").to_pylist(), strict=True))
        g = G.Graph(len(names))
        for a, b, d in rows:
            if a != b:
                (g.directed if d == "->" else g.bidirected).add((at[a], at[b]))
        x, y = at["Xtest"], at["Y"]
        if not g.acyclic():
            found = None
        elif effect == "total":
            found = G.adjustment_sets(g, x, y, (1 << len(names)) - 1)
        else:
            from itertools import combinations

            cut = G.with_latents(G.Graph(g.n, g.directed - {(x, y)}, g.bidirected))
            others = [i for i in range(g.n) if i not in (x, y) and not G.reach(1 << y, g.children()) >> i & 1]
            found = []
            for k in range(len(others) + 1):
                for pick in combinations(others, k):
                    z = sum(1 << i for i in pick)
                    if not any(z & f == f for f in found) and G.separated(cut, x, y, z):
                        found.append(z)
        sets = None if found is None else sorted((sorted(names[i] for i in G.bits_of(z)) for z in found), key=lambda z: (len(z), z))
        return pa.table([pa.array(t.column("model").to_numpy()[:1]), pa.array([sets], pa.list_(pa.list_(pa.string())))], ["model", "mas"])

    return edges.select("model", "from", "to", "direction").groupBy("model").applyInArrow(run, "model int, mas array<array<string>>")


def _pure(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("from") != F.col("to"))


def build_formula_matrix(edges: DataFrame, names: list[str], effect: str = "direct", late: list[str] = ()) -> DataFrame:
    """(model, formula, mas, correct_test, unq_nodes): a test is not correct if a node of ``late`` (those not before Y) is a collider between test and outcome."""
    arrows = _pure(edges).where("direction = '->'").where(F.col("to").isin(*late)) if late else edges.limit(0)
    hit = arrows.where(F.col("from").isin("Xtest", "Y")).groupBy("model", "to").agg(F.count_distinct("from").alias("k")).where("k = 2").select("model").distinct().withColumn("_no", F.lit(True))
    nodes = _pure(edges).groupBy("model").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("from"), F.collect_set("to"))), "_").alias("unq_nodes"))
    m = formulas(edges).join(adjustment(edges, names, effect), "model").join(hit, "model", "left").join(nodes, "model", "left")
    return m.select("model", "formula", "mas", F.when(F.col("_no"), "no").otherwise("yes").alias("correct_test"), "unq_nodes")


def _sets(mas: Column) -> Column:
    """Adjustment sets to compare by: those with nodes, or that there is none."""
    own = F.transform(F.filter(mas, lambda z: F.size(z) > 0), lambda z: F.concat_ws(",", z))
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("none")))


def add_compatible(matrix: DataFrame, reference: int = 1) -> DataFrame:
    """Each hypothesis's agreement with the reference: whether they share an adjustment set, and whether they have the same nodes and test alike."""
    ref = matrix.where(F.col("model") == reference).select(_sets(F.col("mas")).alias("_mas"), F.col("correct_test").alias("_test"), F.col("unq_nodes").alias("_nodes"))
    if not ref.limit(1).count():
        raise EngineError(f"no model {reference}")
    of = lambda ok: F.when(F.col("model") == reference, "reference model").when(ok, "compatible").otherwise("incompatible")
    share: Column = F.arrays_overlap(_sets(F.col("mas")), F.col("_mas"))
    alike = F.col("unq_nodes").eqNullSafe(F.col("_nodes")) & (F.col("correct_test") == F.col("_test"))
    return matrix.crossJoin(F.broadcast(ref)).withColumns({"test_compatible": of(share), "full_model_compatible": of(alike)}).drop("_mas", "_test", "_nodes")  # one row is broadcast


def build_set_matrix(edges: DataFrame, outcome: DataFrame, column: str) -> DataFrame:
    """A row a model, a column a component (0 or 1), and the outcome column of ``outcome`` (model, column)."""
    names = [r[0] for r in edges.select("component").distinct().orderBy("component").collect()]
    return edges.groupBy("model").pivot("component", names).agg(F.lit(1)).na.fill(0).join(outcome.select("model", column), "model", "left")


def find_models(edges: DataFrame, user_models: list[str], nodes: list[dict]) -> DataFrame:
    """(user_model, model): which of the hypotheses each user model is; null if none."""
    spark = edges.sparkSession
    name = {r["label"]: r["name"] for r in nodes}
    own = spark.createDataFrame([(k, name.get(a, a), name.get(b, b), d) for k, a, b, d in parse(user_models)], "user_model int, from string, to string, direction string")
    key = lambda df, k: df.groupBy(k).agg(F.array_sort(F.collect_list(F.struct("from", "to", "direction"))).alias("edges"))
    return key(own, "user_model").join(key(edges, "model"), "edges", "left").select("user_model", "model")


def add_models(edges: DataFrame, user_models: list[str], nodes: list[dict], positions: list[int] | None = None, add=lambda text: True) -> DataFrame:
    """``edges`` with the user's models marked, added where they are not there (if ``add`` says so) and, with ``positions``, moved to these numbers.

    A model that is there swaps its number with the one at its position; a new one pushes those from its position on by one.
    Without positions new ones come last. ``prev_mod`` is the number before.
    """
    if positions is not None and len(positions) != len(user_models):
        raise EngineError("a position is needed for each model")
    spark = edges.sparkSession
    name = {r["label"]: r["name"] for r in nodes}
    there = {r["user_model"]: r["model"] for r in find_models(edges, user_models, nodes).collect()}  # a row a user's model
    last = edges.agg(F.max("model")).first()[0] or 0
    number, marked, new = F.col("model"), [], []
    now = dict(there)
    for k, text in enumerate(user_models, 1):
        to = None if positions is None else positions[k - 1]
        at = now.get(k)
        if at is not None:
            if to is not None and to != at:
                number = F.when(number == at, to).when(number == to, at).otherwise(number)
                new = [(at if m == to else to if m == at else m, *r) for m, *r in new]
                now = {u: at if m == to else to if m == at else m for u, m in now.items()}
            marked.append(there[k])
            continue
        if not add(text):
            continue
        last += 1
        if to is None:
            to = last
        else:
            number = F.when(number >= to, number + 1).otherwise(number)
            new = [(m + 1 if m >= to else m, *r) for m, *r in new]
            now = {u: m + 1 if m is not None and m >= to else m for u, m in now.items()}
        new += [(to, name.get(a, a), name.get(b, b), d, last) for _, a, b, d in parse([text])]
    kept = edges.withColumn("prev_mod", F.col("model")).withColumn("user_mod", F.when(F.col("prev_mod").isin(marked), 1).otherwise(F.col("user_mod")) if marked else F.col("user_mod")).withColumn("model", number.cast("int"))
    more = spark.createDataFrame([(m, a, b, d, 1, a if a == b else f"{a}_{b}", p) for m, a, b, d, p in new], "model int, from string, to string, direction string, user_mod int, component string, prev_mod int")
    return kept.unionByName(more.select(*kept.columns))


@dataclass
class Workflow:
    """Everything of a run: nodes, their edges by model, and the formulas with their sets."""

    nodes: list[dict]
    edges: DataFrame
    formulas: DataFrame


def run(spark: SparkSession, nodes: list[str], timing: list[int], types: list[str], include_subsets: bool = False, user_models: list[str] | None = None, effect: str = "direct") -> Workflow:
    """The whole older workflow."""
    named = roles(nodes, timing, types)
    edges = durable(build_causal_node(spark, nodes, timing, types, user_models, include_subsets))
    end = next(r["timing"] for r in named if r["name"] == "Y")
    return Workflow(named, edges, build_formula_matrix(edges, [r["name"] for r in named], effect, [r["name"] for r in named if r["timing"] >= end and r["name"] != "Y"]))


def plot_places(nodes: list[dict]) -> dict[str, tuple[float, float]]:
    """Places of the nodes: from the latest at 1 to the left by equal steps; test and outcome on the middle line, the others in steps that
    rise by 0.75 from time to time and fall by 2 among nodes of one time."""
    times = sorted({r["timing"] for r in nodes}, reverse=True)
    step = round(2 / (len(times) - 1), 3) if len(times) > 1 else 0.0
    out, height = {}, 0.5
    for i, t in enumerate(times):
        own = [r["name"] for r in nodes if r["timing"] == t and r["name"] not in ("Xtest", "Y")]
        for k, n in enumerate(own):
            out[n] = (round(1 - i * step, 3), height - 2 * k)
        height += 0.75 * bool(own)
        out |= {r["name"]: (round(1 - i * step, 3), 0.0) for r in nodes if r["timing"] == t and r["name"] in ("Xtest", "Y")}
    return out


def plot_frame(workflow: Workflow, models: list[int] | None = None) -> DataFrame:
    """(model, from, to, direction, x, y, xend, yend, label): the edges to draw of all or some models, with their sets."""
    at = workflow.edges.sparkSession.createDataFrame([(n, *p) for n, p in plot_places(workflow.nodes).items()], "n string, x double, y double")
    label = workflow.formulas.select("model", F.concat(F.lit("{"), F.array_join(_sets(F.col("mas")), "},{"), F.lit("}")).alias("label"))
    e = _pure(workflow.edges)
    e = e.where(F.col("model").isin(models)) if models is not None else e
    a, b = at.toDF("from", "x", "y"), at.toDF("to", "xend", "yend")
    return e.join(F.broadcast(a), "from").join(F.broadcast(b), "to").join(label, "model").select("model", "from", "to", "direction", "x", "y", "xend", "yend", "label")
