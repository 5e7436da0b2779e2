"""Collocations against plain counting of every phrase."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from causeway.llm import collocations

SCHEMA = "doc_id long, text string, lang string, word int, n string, blob int"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30, longest=4, top=2000, cover=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        big = {g: a for g, a in c.items() if a >= least and len(g) > 1}
        kept = []
        for g, a in big.items():
            if any(100 * b >= cover * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in big.items() if len(h) > len(g)):
                continue
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus():
    g = np.random.default_rng(4)
    words = ["a", "b", "C", "dé", "日", "e\x00", "f\x1f", "New", "York", "city"]
    rows = []
    for i in range(160):
        said = [words[j] for j in g.zipf(1.6, int(g.integers(0, 40))) % len(words)]
        if i % 3 == 0:
            said += ["New", "York", "city", "hall"]
        rows.append(("".join(w + str(g.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ! "])) for w in said), [None, "en", "und", "x"][i % 4]))
    return [*rows, (None, "en"), ("", "en"), (None, None), ("alone", "only"), ("la " * 30_000, "long"), *[("same row again", "en")] * 40]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "n", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("limit", [collocations.BROADCAST_BYTES, 0])
def test_equal_to_plain_counting(spark, limit, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 4000)
    got = collocations.collocations(frame(spark, corpus()), least=5, top=25, broadcast_bytes=limit)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(corpus(), least=5, top=25)


def test_defaults_and_order_of_ties(spark):
    rows = [("x a, x b, x é, X Z!", "l")] * 30 + [("p q r s t", "l")] * 31
    got = [tuple(r) for r in collocations.collocations(frame(spark, rows)).collect()]
    assert sorted(got) == plain(rows) and {r[2] for r in got} >= {"p q r s", "q r s t"} and "p q" not in {r[2] for r in got}


def test_products_beyond_64_bits(spark):
    """Counts of trillions, through the tables alone."""
    big = 9 * 10**12
    one = spark.createDataFrame([(0, "l", bytearray(b"a"), big + 1), (1, "l", bytearray(b"b"), big + 6)], "id long, lang string, word binary, n long")
    two = spark.createDataFrame([(0, 1, big, 0)], "left long, right long, n long, id long")
    (r,) = collocations.scored([one, two]).collect()
    assert (r["a"], r["l"], r["r"], r["score"]) == (big, big + 1, big + 6, 2_000_000 * big // (2 * big + 7))


@pytest.mark.parametrize("limit", [collocations.BROADCAST_BYTES, 0])
def test_nothing_frequent(spark, limit):
    for rows in ([], [(None, None)], [("a b c", "en")] * 29, [("a. b. c", "en")] * 40):
        assert collocations.collocations(frame(spark, rows), broadcast_bytes=limit).collect() == []
