"""Periodic runs against plain search over every period."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import queries, runs

RULES = ((6, 4), (2, 2), (5, 3))


def plain(t, least, times):
    """Every stretch of every period, the smallest period of equal stretches."""
    out = {}
    for q in range(1, len(t) // times + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 8)), max_size=12))
def test_runs_equal_plain_search(parts):
    t = [w for u, n in parts for w in u * n]
    for least, times in RULES:
        assert runs.repetitions(t, least, times) == plain(t, least, times)


def test_merging_large_sets():
    g = np.random.default_rng(3)
    t = g.integers(0, 2, 3000).tolist()
    assert runs.repetitions(t) == plain(t, 6, 4)
    small, large = sorted(g.choice(5000, 600, replace=False).tolist()), sorted(-g.choice(5000, 900, replace=False) - 1)
    both, pairs = runs.merge(small, [int(x) for x in large])
    assert both == sorted(small + large) and len(pairs) == sum((a >= 0) != (b >= 0) for a, b in zip(both, both[1:], strict=False))
    assert runs.repetitions([0] * 30_000) == [(0, 30_000, 1)]


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_find_and_digests(spark):
    verse, g = "la la la la la la", np.random.default_rng(5)
    rows = [(1, "a b c"), (2, f"x {verse} y {verse} z"), (2, f"x {verse} y {verse} z"), (3, None), (4, ""), (None, "\t ab\ncd " * 4), (6, " ".join(f"w{x}" for x in g.integers(0, 4, 800))), (7, "é ü " * 40_000)]
    got = sorted(runs.find(documents(spark, rows)).collect(), key=str)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t in rows if d == r["doc_id"]) or ""
        words = text.split()
        found = plain(words, 6, 4) if len(words) < 1000 else [(0, 80_000, 2)]
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == found
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    (two, *_) = runs.digests(runs.find(documents(spark, rows))).where("doc_id = 2").collect()
    assert (two["n_runs"], two["start"], two["length"], two["period"], two["exponent_milli"]) == (2, 1, 6, 1, 6000)
    assert two["runs_sha256"] == hashlib.sha256(b"1,6,1\n8,6,1\n").hexdigest() and two["collapsed_sha256"] == hashlib.sha256(b"x la y la z").hexdigest()
    none = runs.digests(runs.find(documents(spark, rows))).where("doc_id = 3").first()
    assert none["n_runs"] == 0 and none["start"] is none["length"] is none["period"] is none["exponent_milli"] is None
    assert none["runs_sha256"] == none["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()


def test_most_periods_are_exact_and_first(spark):
    """7/1 beats 13/2; of equal ones the first counts, then the smaller period."""
    r = runs.digests(runs.find(documents(spark, [(1, "a b " * 6 + "a x " + "c " * 7 + "y " + "d " * 7)]))).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (3, 14, 7, 1, 7000)


def test_collapse_carries_columns(spark):
    df = spark.createDataFrame([(1, "k k k k k k  end", "s", 7), (2, "as  it is", None, 8), (3, None, "t", None)], "doc_id long, text string, runs string, n_words long")
    got = {r["doc_id"]: r for r in runs.collapse(df).collect()}
    assert runs.collapse(df).columns == df.columns and got[1]["text"] == "k end" and got[2]["text"] == "as  it is" and got[3]["text"] is None and got[1]["runs"] == "s" and got[2]["n_words"] == 8


def test_no_rows(spark):
    none = documents(spark, [])
    assert runs.digests(runs.find(none)).count() == 0 == runs.collapse(none).count()


def test_planted_words(spark):
    """The query's documents repeat as its contract says, by plain Python."""
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(400)] + [(None, "a b"), (5, None)]
    got = {(r["doc_id"], r["text"]) for r in queries._periodic(documents(spark, rows)).collect()}
    want = set()
    for i, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            text = " ".join(w[j] if j < a else w[a + (j - a) % p] for j in range(len(w)))
        want.add((i, text))
    assert got == want
