"""Boolean formulas over edge variables: three-valued evaluation, simplification, and translation to columns.

A formula is a nested tuple: ("var", name), ("not", f), ("and", f, ...), ("or", f, ...), ("const", True or False), or
("most", k, name, ...): at most k of the variables are true.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.plans.diagrams import Diagram, TooLarge  # noqa: F401

TRUE, FALSE = ("const", True), ("const", False)


def var(name: str) -> tuple:
    return ("var", name)


def neg(f: tuple) -> tuple:
    return ("const", not f[1]) if f[0] == "const" else f[1] if f[0] == "not" else ("not", f)


def _many(op: str, stop: tuple, parts) -> tuple:
    out = []
    for f in parts:
        if f == stop:
            return stop
        if f[0] != "const":
            out += [g for g in (f[1:] if f[0] == op else (f,)) if g not in out]
    if any(neg(f) in out for f in out):
        return stop
    return neg(stop) if not out else out[0] if len(out) == 1 else (op, *out)


def conj(*parts: tuple) -> tuple:
    return _many("and", FALSE, parts)


def disj(*parts: tuple) -> tuple:
    return _many("or", TRUE, parts)


def at_most(k: int, names) -> tuple:
    names = tuple(sorted(names))
    if k < 0:
        return FALSE
    return TRUE if k >= len(names) else ("most", k, *names) if k else conj(*(neg(var(n)) for n in names))


def evaluate(f: tuple, values: Mapping[str, bool | None]) -> bool | None:
    """Kleene's logic: null where a variable is not known and matters."""
    if f[0] == "const":
        return f[1]
    if f[0] == "var":
        return values.get(f[1])
    if f[0] == "most":
        on = [values.get(n) for n in f[2:]]
        return False if on.count(True) > f[1] else True if len(on) - on.count(False) <= f[1] else None
    parts = [evaluate(g, values) for g in f[1:]]
    if f[0] == "not":
        return None if parts[0] is None else not parts[0]
    stop = f[0] == "or"
    return stop if stop in parts else None if None in parts else not stop


def settle(f: tuple, values: Mapping[str, bool]) -> tuple:
    """The formula with some variables known, simplified."""
    if f[0] == "var":
        return ("const", values[f[1]]) if f[1] in values else f
    if f[0] == "const":
        return f
    if f[0] == "most":
        return at_most(f[1] - sum(values.get(n, False) for n in f[2:]), [n for n in f[2:] if n not in values])
    parts = [settle(g, values) for g in f[1:]]
    return neg(parts[0]) if f[0] == "not" else conj(*parts) if f[0] == "and" else disj(*parts)


def variables(f: tuple) -> set[str]:
    return {f[1]} if f[0] == "var" else set(f[2:]) if f[0] == "most" else set() if f[0] == "const" else set().union(*map(variables, f[1:]))


def literals(f: tuple) -> dict[str, bool]:
    """What a conjunction says outright of single variables."""
    parts = f[1:] if f[0] == "and" else (f,)
    return {g[1]: True for g in parts if g[0] == "var"} | {g[1][1]: False for g in parts if g[0] == "not" and g[1][0] == "var"}


def column(f: tuple, on: Callable[[str], Column]) -> Column:
    """The formula over columns: ``on`` gives a variable's. SQL's logic is Kleene's too."""
    if f[0] == "const":
        return F.lit(f[1])
    if f[0] == "var":
        return on(f[1])
    if f[0] == "most":
        return reduce(lambda a, b: a + b, (on(n).cast("int") for n in f[2:])) <= f[1]
    parts = [column(g, on) for g in f[1:]]
    return ~parts[0] if f[0] == "not" else reduce(lambda a, b: a & b if f[0] == "and" else a | b, parts)


def models(f: tuple, order: list[str], most_nodes: int | None = None) -> int:
    """How many assignments of these variables satisfy the formula, by a decision diagram."""
    d = Diagram(order, most_nodes)
    return d.count(d.of(f))


def satisfiable(f: tuple, order: list[str], most_nodes: int | None = None) -> bool:
    """Whether any assignment satisfies the formula."""
    return Diagram(order, most_nodes).of(f) != 0
