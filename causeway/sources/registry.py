"""Component registries: built from nodes, read from rows or Parquet, checked, and written.

A registry is the (small, driver-side) list of every node and edge that models may claim. Its rows are a DataFrame for joins; its
attributes (timings, focal pair, constraints) travel in the column metadata of ``comp_id``, so Parquet keeps them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.errors import RegistryError

#: Columns and directions of the format: fixed values.
CORE = ["comp_id", "type", "source", "target", "direction", "description", "fixed_status", "observed"]
SCHEMA = T.StructType([T.StructField(c, T.BooleanType() if c == "observed" else T.StringType()) for c in CORE])
DIRECTIONS = ("->", "<->")


@dataclass
class Registry:
    rows: list[dict]
    meta: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.rows = sorted(self.rows, key=lambda r: r["comp_id"])
        self.nodes = [r for r in self.rows if r["type"] == "node"]
        self.edges = [r for r in self.rows if r["type"] == "edge"]
        self.ordinal = {r["comp_id"]: i for i, r in enumerate(self.rows)}
        self.node_id = {r["source"]: r["comp_id"] for r in self.nodes}
        self.words = -(-len(self.rows) // 64)

    def frame(self, spark: SparkSession) -> DataFrame:
        extra = sorted({k for r in self.rows for k in r} - set(CORE))
        schema = T.StructType([*SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in extra)])
        df = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) if c in extra else r[c] for c in [*CORE, *extra]) for r in self.rows], schema)
        return df.withMetadata("comp_id", {"registry": json.dumps(self.meta)})

    def write(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    def summary(self) -> dict[str, int]:
        arrows = [r["direction"] for r in self.edges]
        return {"total": len(self.rows), "nodes": len(self.nodes), "edges": len(self.edges), "directed": arrows.count("->"), "bidirected": arrows.count("<->")}

    def edge(self, source: str, target: str, direction: str = "->") -> str:
        return next(r["comp_id"] for r in self.edges if (r["source"], r["target"], r["direction"]) == (source, target, direction))

    def ends(self, comp_id: str) -> tuple[str, str]:
        r = self.rows[self.ordinal[comp_id]]
        return self.node_id[r["source"]], self.node_id[r["target"]]


def _check(r: dict) -> str | None:
    edge = r["type"] == "edge"
    if r["type"] not in ("node", "edge"):
        return "type must be node or edge"
    if not re.fullmatch(r"C\d{4,}", r["comp_id"] or ""):
        return "comp_id must be C and at least four digits"
    if not r["source"] or not r["description"]:
        return "source and description must not be empty"
    if edge != (r["target"] is not None) or edge != (r["direction"] is not None):
        return "edges, and only they, have a target and a direction"
    if edge and r["direction"] not in DIRECTIONS:
        return "direction must be -> or <->"
    if r["fixed_status"] not in (None, "causal"):
        return "fixed_status must be causal or null"
    return None


def from_rows(rows: list[dict], meta: dict | None = None) -> Registry:
    """A checked registry; extra keys stay, missing fixed_status and observed become null and true."""
    if not rows:
        raise RegistryError("the registry is empty", "EMPTY_REGISTRY")
    out = []
    for r in rows:
        r = {k: None if isinstance(v, float) and v != v else v for k, v in r.items()}
        r = {c: r.get(c) for c in CORE} | r
        r["observed"] = True if r["observed"] is None else bool(r["observed"])
        if why := _check(r):
            raise RegistryError(f"{r['comp_id']}: {why}")
        out.append(r)
    if len({r["comp_id"] for r in out}) < len(out):
        raise RegistryError("comp_id must be unique")
    made = Registry(out, meta or {})
    for r in made.edges:
        if r["source"] not in made.node_id or r["target"] not in made.node_id:
            raise RegistryError(f"{r['comp_id']}: an endpoint is no node of the registry")
    return made


def read(spark: SparkSession, path: str) -> Registry:
    df = spark.read.parquet(path)
    if missing := [c for c in CORE[:6] if c not in df.columns]:
        raise RegistryError(f"columns are missing: {', '.join(missing)}")
    meta = df.schema["comp_id"].metadata.get("registry")
    return from_rows([r.asDict() for r in df.collect()], json.loads(meta) if meta else {})


def _options(node: dict) -> list[int] | None:
    if node.get("timing_options"):
        return sorted(set(node["timing_options"]))
    return None if node.get("timing") is None else [node["timing"]]


def build(nodes: list[dict], respect_timing: bool = True, include_bidirectional: bool = False, constraints: list[dict] | None = None, exposure: str | None = None, outcome: str | None = None) -> Registry:
    """All nodes, every eligible edge between them, then required edges that no rule has made."""
    names = [n["name"] for n in nodes]
    if not names or len(set(names)) < len(names):
        raise RegistryError("nodes must be named, each differently", "INVALID_NODES")
    if (exposure is None) != (outcome is None) or (exposure is not None and (exposure == outcome or not {exposure, outcome} <= set(names))):
        raise RegistryError("exposure and outcome must be two of the nodes, or neither be given")
    rules = {(c["source"], c["target"], c["direction"]) if c["direction"] == "->" else (*sorted((c["source"], c["target"])), "<->"): set() for c in constraints or ()}
    for c in constraints or ():
        key = (c["source"], c["target"], c["direction"]) if c["direction"] == "->" else (*sorted((c["source"], c["target"])), "<->")
        rules[key].add(c["rule"])
        if c["rule"] not in ("require", "forbid", "allow") or not {c["source"], c["target"]} <= set(names):
            raise RegistryError(f"constraint {c} is not valid")
    for key, own in rules.items():
        if {"require", "forbid"} <= own:
            raise RegistryError(f"{key} is both required and forbidden")
    has = lambda key, rule: rule in rules.get(key, ())
    time = {n["name"]: _options(n) for n in nodes}
    focal = (exposure, outcome, "->")
    if exposure is not None and has(focal, "forbid"):
        raise RegistryError("the focal edge can't be forbidden")
    ordered = exposure is not None and all(t is None for t in time.values())  # exposure comes first though no times are given
    barred = {(outcome, exposure, "->"), (*sorted((exposure, outcome)), "<->")} if ordered else set()
    if any(has(k, "require") for k in barred):
        raise RegistryError("the exposure must precede the outcome when no timing is given")
    rows, warnings = [], []

    def add(kind: str, source: str, target: str | None, direction: str | None, text: str, fixed: bool, observed: bool = True) -> None:
        rows.append({"comp_id": f"C{len(rows) + 1:04d}", "type": kind, "source": source, "target": target, "direction": direction, "description": text, "fixed_status": "causal" if fixed else None, "observed": observed})

    for n in nodes:
        add("node", n["name"], None, None, n.get("description") or n["name"], False, n.get("observed", True))
    listed = any(k[2] == "->" and "allow" in own for k, own in rules.items())
    made = set()
    for s in names:
        for t in names:
            key = (s, t, "->")
            if s == t or key in barred or has(key, "forbid"):
                continue
            if key != focal:
                if respect_timing and time[s] is not None and time[t] is not None and min(time[s]) >= max(time[t]):
                    continue
                if listed and not has(key, "allow"):
                    continue
            if respect_timing and (time[s] is None or time[t] is None) and not all(x is None for x in time.values()):
                warnings.append(f"{s} -> {t} is kept: a timing is missing")
            add("edge", s, t, "->", f"{s} -> {t}", key == focal or has(key, "require"))
            made.add(key)
    for a, b in combinations(names, 2):
        key = (*sorted((a, b)), "<->")
        if key in barred or has(key, "forbid"):
            continue
        wanted = has(key, "allow") or has(key, "require")
        if not wanted and (not include_bidirectional or (respect_timing and time[a] is not None and time[b] is not None and not set(time[a]) & set(time[b]))):
            continue
        add("edge", key[0], key[1], "<->", f"{key[0]} <-> {key[1]}", has(key, "require"))
        made.add(key)
    for key in sorted(k for k, own in rules.items() if "require" in own and k not in made):
        s, t, arrow = key
        if arrow == "->" and time[s] is not None and time[t] is not None and len(time[s]) == len(time[t]) == 1 and time[s][0] >= time[t][0]:
            raise RegistryError(f"{s} -> {t} is required, but {s} is not earlier")
        add("edge", s, t, arrow, f"{s} {arrow} {t} (required)", True)
    meta = {"timing": {n["name"]: n.get("timing") for n in nodes}, "timing_options": {k: v for k, v in time.items() if v is not None}, "exposure": exposure, "outcome": outcome, "constraints": constraints or []}
    made_registry = from_rows(rows, meta)
    made_registry.warnings = warnings
    return made_registry


def interview(ask: Callable[[str], str]) -> tuple[Registry, dict]:
    """A registry from answers to prompts, and the options for its expansion (times allowed, nodes that must be there).

    ``ask`` gets each prompt and gives the answer, so it may be ``input`` or a table of answers.
    """
    said = lambda prompt: (ask(prompt) or "").strip()
    listed = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    names = listed(said("Variables, separated by commas: "))
    exposure, outcome = said("Exposure: "), said("Outcome: ")
    times = {}
    for n in names:
        try:
            times[n] = sorted({int(x) for x in listed(said(f"Time of {n} (a whole number; for other variables than exposure and outcome up to two): "))})
        except ValueError:
            raise RegistryError(f"a time of {n} is no whole number", "INVALID_NODES") from None
        if not 1 <= len(times[n]) <= (1 if n in (exposure, outcome) else 2):
            raise RegistryError(f"{n} has {len(times[n])} times", "INVALID_NODES")
    if sum(len(t) == 2 for t in times.values()) > 2:
        raise RegistryError("at most two variables may have two times", "INVALID_NODES")

    def pairs(prompt: str) -> list[tuple[str, str]]:
        text = said(prompt)
        found = re.findall(r"\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*\)", text)
        if re.sub(r"\([^()]*\)|[\s,]", "", text) or any(a == b or not {a, b} <= set(names) for a, b in found):
            raise RegistryError(f"pairs are written (A,B),(C,D), of two variables each: {text}")
        return found

    rules = [("Required edges, as (A,B),(B,C), or nothing: ", "->", "require"), ("Forbidden edges, or nothing: ", "->", "forbid"), ("Required hidden common causes, or nothing: ", "<->", "require"), ("Possible hidden common causes, or nothing: ", "<->", "allow")]
    asked = [{"source": a, "target": b, "direction": arrow, "rule": rule} for prompt, arrow, rule in rules for a, b in pairs(prompt)]
    optional = listed(said("Variables that may be absent, separated by commas, or nothing: "))
    if not set(optional) <= set(names) - {exposure, outcome}:
        raise RegistryError("exposure and outcome can't be absent, nor can what isn't a variable")
    made = build([{"name": n, "timing": t[0] if len(t) == 1 else None, "timing_options": t} for n, t in times.items()], constraints=asked, exposure=exposure, outcome=outcome)
    return made, {"timing_options": times, "node_policy": "optional" if optional else "all-present", "required_nodes": [n for n in names if n not in optional]}


def claims_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """State records with their types."""
    return spark.createDataFrame([tuple(r.get(c) for c in ("model_id", "comp_id", "status", "timing")) for r in rows], "model_id string, comp_id string, status string, timing int")


def parse_claims(text: DataFrame, column: str = "value") -> DataFrame:
    """State records from JSON lines."""
    return text.select(F.from_json(column, "model_id string, comp_id string, status string, timing int").alias("r")).select("r.*")
