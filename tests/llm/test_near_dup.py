"""Near duplicates against brute force over all pairs."""

import re
from collections import Counter
from functools import partial
from math import log

import numpy as np
import pytest

from causeway.llm import exchange, near_dup
from causeway.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def vectors(texts):
    out, df = [], Counter()
    for t in texts:
        w = WORD.findall((t or "").lower())
        s = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        out.append(s)
        df.update(s.keys())
    n = len(texts)
    return [{k: (1 + log(c)) * (1 + log((1 + n) / (1 + df[k])) / log(1 + n)) for k, c in s.items()} for s in out]


def similarity(a, b):
    both = sum(min(x, b[k]) for k, x in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def brute(rows):
    v, parent = vectors([t for _, t in rows]), list(range(len(rows)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    close = 0
    for i in range(len(rows)):
        for j in range(i):
            s = similarity(v[i], v[j])
            close += abs(s - 0.8) < 1e-4
            if s >= 0.8 or rows[i][1] and rows[i][1] == rows[j][1]:
                parent[find(i)] = find(j)
    assert not close  # no pair too near the bound to tell in floats
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def corpus(n=90, seed=5):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 300, k)]
    line = word(12)
    rows, bases = [], [word(int(rng.integers(60, 200))) for _ in range(6)]
    for i in range(n):
        x = list(bases[i % 6]) if i % 3 == 0 else word(int(rng.integers(0, 150)))
        for _ in range(int(rng.integers(0, 4))):
            if x:
                x[int(rng.integers(0, len(x)))] = f"n{i}"
        if i % 2:
            x += line
        rows.append((1000 - i, " ".join(x)))
    rows += [(2000 + i, t) for i, t in enumerate(["", None, "", "!!!", "!!!", "one two", "One, two", "one three", rows[0][1], rows[0][1], rows[3][1].upper()])]
    return [*rows, (None, rows[6][1]), (None, "solo"), (5, rows[1][1]), (5, "other words here")]


@pytest.mark.parametrize("texts", [512, 4])
def test_as_brute_force(spark, tmp_path, monkeypatch, texts):
    monkeypatch.setattr(near_dup, "TASK_TEXTS", texts)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "k", 3) for d, t in rows], "doc_id long, text string, uid string, b int").repartition(4)
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = sorted((-1 if a is None else a, -1 if b is None else b) for a, b in near_dup.near_duplicates(df).collect())
    want = brute(rows)
    assert got == want and len({c for _, c in want}) < len(rows) - 20
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    out = [r["doc_id"] for r in kept.collect()]
    groups = {c for d, c in want if c != -1}
    assert sorted(x for x in out if x is not None and x != 5) == sorted(groups - {5}) and None in out
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_chains_of_unlike_texts_dont_meet_as_one_group(spark, tmp_path, monkeypatch):
    """Each text shares bands with the next few alone, but all are one group: tasks hold so many rows as bands are shared, not the group times the group."""
    rng = np.random.default_rng(3)
    w = [f"w{x}" for x in rng.integers(0, 10**9, 2000)]
    rows = [(i, " ".join(w[5 * i : 5 * i + 40])) for i in range(300)] + [(1000 + i, " ".join([*w[50 * i : 50 * i + 40], "end"])) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(near_dup, "TASK_TEXTS", 4)
    seats, compared = [], near_dup._compared
    monkeypatch.setattr(near_dup, "_compared", lambda s, *a: seats.append(s) or compared(s, *a))
    got = sorted(map(tuple, near_dup.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()))
    assert got == brute(rows) and len({c for _, c in got}) == 300
    assert sum(s.count() for s in seats) < 60 * len(rows)


def test_wide_columns_move_no_chunk(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(5, 60)))), "z" * int(rng.integers(0, 900))) for i in range(600)]
    rows += [(1000 + i, rows[7 * i][1], "copy") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, wide string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(exchange, "pack", partial(exchange.pack, most=2048))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        plain, carried = ({(r["b"], tuple(exchange.Chunk.of(bytes(r["blob"])).ids.tolist())) for r in exchange.pack(df, carry=c).collect()} for c in (None, ["doc_id", "wide"]))
        assert plain == carried and len(plain) > 50 and sum(len(i) for _, i in plain) == len(rows)
        assert {r["doc_id"] for r in near_dup.keep_one(df).collect()} == set(range(600))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_samples_agree_as_often_as_similar():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    w = rng.random((2, 400)).astype(np.float32) + 0.5
    w[1, :300] = w[0, :300]
    _, s = near_dup.samples(np.concatenate([h, h]), w.ravel(), np.repeat([0, 1], 400), 2000)
    true = np.minimum(*w).sum() / np.maximum(*w).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.03


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = sorted((x, find(x)) for x in parent if find(x) != x)
    assert sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()) == want


def test_components_with_large_nodes(spark):
    from causeway.llm import components as C

    rng = np.random.default_rng(4)
    edges = [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(1001, 1300)] + [(399, 1299)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (300, 2))]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in parent if root(x) != x}
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (20, C.LARGE):
        assert {r["u"]: r["v"] for r in C.components(df, most).collect()} == want


def test_texts_of_unlike_weight_meet(spark, tmp_path):
    """Each text has a longer version, most of them in the next class of weight: nearly all pairs of similarity 0.8 and more are linked."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(120):
        n = int(rng.integers(100, 300))
        w = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, *(f"w{x}" for x in rng.integers(0, 10**9, int(n * 0.17)))]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    v = vectors([t for _, t in rows])
    close = [i for i in range(120) if similarity(v[2 * i], v[2 * i + 1]) >= 0.8]
    got = dict(near_dup.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert len(close) > 100 and sum(got[2 * i] == got[2 * i + 1] for i in close) >= 0.98 * len(close)
    assert len(set(got.values())) >= 120
