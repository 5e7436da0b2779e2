"""Substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest

from causeway.llm import exchange as X
from causeway.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 40, k)]
    shared = [word(int(rng.integers(13, 60))) for _ in range(8)]
    line = word(6)
    rows = []
    for i in range(n):
        x = word(int(rng.integers(0, 60)))
        for _ in range(int(rng.integers(0, 3))):
            p = shared[int(rng.integers(0, 8))]
            a = int(rng.integers(0, max(1, len(p) - 12)))
            at = int(rng.integers(0, len(x) + 1))
            x[at:at] = p[a : a + int(rng.integers(8, 60))]
        if i % 7 == 0:
            x += line * int(rng.integers(1, 12))
        if i % 10 == 9:
            x = rows[-3][1].split()
        rows.append((int(i * 3 % n), ("\n" if i % 4 == 0 else "  ").join(x)))
    return [*rows, (rows[0][0], rows[1][1]), (500, None), (501, ""), (502, " " + rows[5][1] + "\n")]


@pytest.mark.parametrize(("size", "hot", "bits"), [(13, passages.HOT, 64), (5, 1, 64), (13, passages.HOT, 9), (5, 2, 14)])
def test_as_brute_force(spark, tmp_path, size, hot, bits):
    rows = corpus(size)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, b int, k string").repartition(5)
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = sorted(tuple(r) for r in passages.digests(df, size=size, hot=hot, bits=bits).collect())
    want = brute(rows, size)
    assert got == want and sum(r[2] for r in want) > 100
    kept = passages.remove(df, size=size)
    assert kept.columns == df.columns
    out = sorted((r["doc_id"], hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest()) for r in kept.collect())
    assert out == sorted((a, d) for a, _, _, d in want)
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[500] is None
    assert passages.digests(df.limit(0)).count() == 0


def test_collisions_confirm_nothing():
    a, b = np.arange(20), np.arange(100, 120)
    assert passages.confirm([a], np.array([1]), [(b, 1), (np.concatenate([b, a[3:17], b]), 1), (a[:12], 1)], 13) == [[], [(20, 34)], []]


def test_windows_without_a_confirmed_stretch():
    assert passages.unconfirmed(20, [(0, 15)], 13) == [3, 4, 5, 6, 7] and passages.unconfirmed(20, [(0, 20)], 13) == [] and passages.unconfirmed(5, [], 13) == []


def test_one_partition_and_long_texts(spark, tmp_path):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    long = " ".join(f"v{i}" for i in range(70000))
    rows = [(1, long), (2, "z " + long), (3, "q" * 200000), (4, "q" * 200000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in passages.digests(spark.read.parquet(str(tmp_path / "d"))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == {1: (70000, 0), 2: (70001, 70000), 3: (1, 0), 4: (1, 0)}


def test_rows_without_a_fixed_order_are_stored_first(spark, tmp_path):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert X.settled(df) is not df
    df.write.parquet(str(tmp_path / "d"))
    plain = spark.read.parquet(str(tmp_path / "d")).where("doc_id is not null").select("text", "doc_id")
    assert X.settled(plain) is plain
    assert sorted(tuple(r) for r in passages.digests(df).collect()) == brute(rows, 13)
