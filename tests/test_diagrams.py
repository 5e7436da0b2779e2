"""Decision diagrams against truth tables, and even draws."""

from collections import Counter
from decimal import Decimal
from itertools import product

import numpy as np
import pytest

from causeway.plans import formulas as B
from causeway.plans import symbolic as Y
from causeway.plans.diagrams import Diagram, TooLarge


def random_formula(g, names, depth):
    kind = g.integers(0, 5) if depth else 0
    if kind == 0:
        return B.var(str(g.choice(names)))
    if kind == 1:
        return B.neg(random_formula(g, names, depth - 1))
    if kind == 2:
        own = [str(x) for x in g.choice(names, int(g.integers(1, len(names) + 1)), replace=False)]
        return B.at_most(int(g.integers(0, len(own) + 1)), own)
    return (B.conj if kind == 3 else B.disj)(*(random_formula(g, names, depth - 1) for _ in range(int(g.integers(2, 4)))))


def test_counts_and_choices_as_by_truth_table():
    g = np.random.default_rng(0)
    names = list("abcdef")
    for _ in range(120):
        f, order = random_formula(g, names, 3), [str(x) for x in g.permutation(names)]
        want = {pick for pick in product((False, True), repeat=6) if B.evaluate(f, dict(zip(order, pick, strict=True)))}
        d = Diagram(order)
        root = d.of(f)
        assert d.count(root) == len(want) == B.models(f, order) and B.satisfiable(f, order) == bool(want)
        assert {tuple(bool(d.chosen(root, i) >> j & 1) for j in range(6)) for i in range(len(want))} == want
        assert d.of(B.neg(B.neg(f))) == root and d.both(root, d.negation(root)) == 0


def test_nodes_are_shared_and_bounded():
    order = [f"v{i}" for i in range(40)]
    d = Diagram(order)
    odd = d.of(B.FALSE)
    for n in order:  # parity: two nodes a variable
        v = d.of(B.var(n))
        odd = d.negation(d.both(d.negation(d.both(odd, d.negation(v))), d.negation(d.both(v, d.negation(odd)))))
    assert d.count(odd) == 1 << 39
    with pytest.raises(TooLarge):
        B.models(B.disj(*(B.conj(B.var(f"v{i}"), B.var(f"v{i + 20}")) for i in range(20))), order, 1000)


def big():
    return Y.from_nodes([{"name": f"n{i:02}", "timing": i} for i in range(10)], "n00", "n09")


def test_even_draws_under_a_tight_constraint(spark):
    """Forty-five edges, of which a handful of assignments is left: each comes equally often."""
    u = big()
    free = u.names[:3]
    tight = B.conj(*(B.neg(B.var(n)) for n in u.names[5:]), B.disj(*(B.conj(B.var(a), B.var(b)) for a, b in ((free[0], free[1]), (u.names[3], u.names[4])))))
    s = Y.space(spark, u, B.disj(tight, B.conj(*(B.var(n) for n in u.names))), samples=4000, most_free=8)
    got = Counter(map(tuple, s.df.collect()))
    n = Y.count(u, B.disj(tight, B.conj(*(B.var(x) for x in u.names))))
    assert not s.exact and n == len(got) == 15 and sum(got.values()) == 4000
    assert sum((c - 4000 / n) ** 2 / (4000 / n) for c in got.values()) < 45  # chi-square of 14 degrees: one in 20,000 is above
    one = B.conj(*(B.var(x) if i % 2 else B.neg(B.var(x)) for i, x in enumerate(u.names[:40])))
    rows = Y.sample(spark, u, B.disj(one, B.FALSE), 10, most_free=2).collect()
    assert len(rows) == 10
    assert Y.sample(spark, u, B.conj(B.at_most(1, u.names[:2]), B.var(u.names[0]), B.var(u.names[1])), 10, most_free=8).collect() == []


def test_masses_beyond_64_bits_are_exact(spark):
    u = Y.from_nodes([{"name": f"n{i:02}", "timing": i} for i in range(13)], "n00", "n12")
    c = B.at_most(3, [n for n in u.names if n.startswith("e__n00")])
    rows = Y.query_classes(spark, u, c, mode="full", most_atoms=2).collect()
    assert all(r["exact"] and isinstance(r["mass"], Decimal) for r in rows)
    assert sum(int(r["mass"]) for r in rows) == Y.count(u, c) > 1 << 64 and abs(sum(r["proportion"] for r in rows) - 1) < 1e-9
