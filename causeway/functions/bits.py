"""Sets of components as 64-bit words in plain columns.

A set named ``np`` over a registry of up to 64 * k components is the columns ``np0 .. np{k-1}``. Expressions on words stay in generated code.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(name: str, n: int, side: str = "") -> list[Column]:
    return [F.col(f"{side}{name}{i}") for i in range(n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def literal(bits: Iterable[int], n: int) -> list[int]:
    """The words of a fixed set."""
    out = [0] * n
    for b in bits:
        out[b >> 6] |= 1 << (b & 63)
    return [signed(x) for x in out]


def each(fn: Callable[..., Column], *sets: list) -> list[Column]:
    return [fn(*w) for w in zip(*sets, strict=True)]


def count(sets: list[Column]) -> Column:
    return reduce(add, (F.bit_count(w) for w in sets))


def has(sets: list[Column], bit: int) -> Column:
    return F.shiftright(sets[bit >> 6], bit & 63).bitwiseAND(F.lit(1)) == 1


def any_set(sets: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (w != 0 for w in sets))


#: Neighbouring bits that are looked up at once.
_RUN = 8


def _looked_up(sets: list[Column], names: list[tuple[int, str]], of: Callable, kind: str) -> list[Column]:
    """Up to ``_RUN`` neighbouring bits are one place in a constant table of what ``of`` makes of their subsets' names."""
    runs: list[list[tuple[int, str]]] = []
    for b, s in names:
        if runs and len(runs[-1]) < _RUN and b == runs[-1][-1][0] + 1 and b & 63:
            runs[-1].append((b, s))
        else:
            runs.append([(b, s)])
    parts = []
    for run in runs:
        word, first = divmod(run[0][0], 64)
        at = F.shiftrightunsigned(sets[word], first).bitwiseAND(F.lit((1 << len(run)) - 1)).cast("int")
        table = json.dumps([of([s for i, (_, s) in enumerate(run) if x >> i & 1]) for x in range(1 << len(run))])
        parts.append(F.get(F.from_json(F.lit(table), f"array<{kind}>"), at))
    return parts


def members(sets: list[Column], names: list[tuple[int, str]]) -> Column:
    """The names of the set bits, in this order."""
    parts = _looked_up(sets, names, list, "array<string>")
    return (F.concat(*parts) if len(parts) > 1 else parts[0]) if parts else F.array().cast("array<string>")


def joined(*sets: tuple[list[Column], list[tuple[int, str]]], by: str = ",") -> Column:
    """The names of the set bits of these sets in one string, ``members`` of each without an array."""
    return F.concat_ws(by, *(part for words_, names in sets for part in _looked_up(words_, names, lambda x: by.join(x) if x else None, "string")))


def union_of(bits: Column, value: Column, n: int, when: Column) -> list[Column]:
    """Aggregates: the words of the set of all bits for which ``when`` holds."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.bitwiseAND(F.lit(63)).cast("int"))
    return [F.coalesce(F.bit_or(F.when(when & (F.shiftright(bits, 6) == i), one)), F.lit(0).cast("bigint")) for i in range(n)]
