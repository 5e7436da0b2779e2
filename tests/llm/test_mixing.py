"""Mixes against targets in exact fractions and the best of all subsets."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, key string, size string, taken int"


def exact_targets(sizes: dict):
    """Target of each source, by taking the excess of those above their most and sharing it again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    got = {s: Fraction(sum(sizes.values()) * weight[s], sum(weight.values())) for s in order}
    full = set()
    while above := {s for s in order if s not in full and got[s] > 3 * sizes[s]}:
        full |= above
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        left = sum(weight[s] for s in order if s not in full)
        got = {s: Fraction(3 * sizes[s]) if s in full else Fraction(rest * weight[s], left) for s in order}
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 14), min_size=1, max_size=10), st.floats(0, 3), st.sampled_from([2, 1 << 16]))
def test_fit_is_the_nearest_sum(docs, share, window):
    total = sum(docs)
    sizes, counts = np.unique(docs, return_counts=True)
    whole, more = mixing.fit(sizes, counts, share * total, window)
    assert (more >= 0).all() and (more <= counts).all() and whole + bool(more.any()) <= 3
    sums = {0}
    for d in docs:
        sums |= {x + d for x in sums}
    budget = share * total - whole * total
    assert abs(int(sizes @ more) - budget) <= min(abs(x - budget) for x in sums) + 1


def test_large_budgets_fit_to_the_word():
    g = np.random.default_rng(0)
    sizes = np.unique(g.integers(1, 20_000, 8_000))
    counts = g.integers(1, 50, len(sizes))
    for share in (0.1, 0.37, 1.9, 2.99):
        whole, more = mixing.fit(sizes, counts, share * float(sizes @ counts))
        assert (more <= counts).all() and abs(whole * int(sizes @ counts) + int(sizes @ more) - share * float(sizes @ counts)) <= 0.51


def mixed(spark, rows, **kw):
    return mixing.mix(spark.createDataFrame([(*r, "k", "s", 1) for r in rows], SCHEMA), **kw).collect()


def test_mix(spark):
    g = np.random.default_rng(1)
    names = ["b", "a", "ä", "Z", "", None, "a0"]
    rows = [(i, " ".join("w" for _ in range(int(g.integers(0, 60)))), names[min(int(g.integers(0, 14)), 6)]) for i in range(900)]
    rows += [(1000 + i, "same size here", "a0") for i in range(700)] + [(None, "x y", "b"), (5, None, "b"), (6, "", "only empty"), (7, "long " * 50_000, "Z"), (8, "t", "b"), (8, "t", "b")]
    got = mixed(spark, rows)
    source = defaultdict(int)
    for _, t, s in rows:
        source[s] += len((t or "").split())
    want = exact_targets(source)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, len((t or "").split()), source[s]) for i, t, s in rows)
    by = {(i, len((t or "").split()), source[s]): s for i, t, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = by[r["doc_id"], r["size"], r["source_size"]]
        taken[s] += r["taken"]
        assert abs(r["target"] - float(want[s])) < 1e-6 * max(1, float(want[s])) and 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    longest = defaultdict(int)
    for _, t, s in rows:
        longest[s] = max(longest[s], len((t or "").split()))
    assert all(abs(taken[s] - want[s]) <= (1 if s != "Z" else longest[s] / 2 + 1) for s in source)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixed(spark, rows[::-1])))  # neither order nor partitions matter
    assert Counter(map(tuple, got)) != Counter(map(tuple, mixed(spark, rows, seed=1)))


def test_no_rows_and_no_words(spark):
    assert mixed(spark, []) == []
    (r,) = mixed(spark, [(1, None, None)])
    assert (r["size"], r["source_size"], r["target"], r["taken"]) == (0, 0, 0.0, 0)


def test_query_meets_its_targets(spark):
    got = queries.op13_source_mix(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text").toPandas()
    docs["n"] = [len(t.split()) for t in docs["text"]]
    want = exact_targets(docs.groupby("source")["n"].sum().astype(int).to_dict())
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(got)
    sums = both.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert all(abs(sums["target"][s] - float(want[s])) < 1e-6 and abs(sums["taken"][s] - float(want[s])) <= 1 for s in want)
