"""Gradients and windows of the attention model, and the scores against counting."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers as P
import pytest

from causeway.llm import lm, lm_scoring, queries

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in lm.initial().items()}
    v = lm.Vocabulary(rng.integers(0, 50, 3000), rng.random(3000) < 0.5)
    v.arrange(rng.integers(0, 3, (lm.CLASSES, lm.CLASSES)))
    v.groups, v.members = v.groups.astype(np.float64), v.members.astype(np.float64)
    x, y = rng.integers(0, lm.CLASSES, (3, 10)), rng.integers(0, lm.CLASSES, (3, 10))
    x[0, 7:], y[0, 6:] = lm.CLASSES, lm.CLASSES
    _, g = lm.step(m, v, x, y)
    for k in m:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = m[k][at]
        up, down = (m[k].__setitem__(at, old + e) or lm.step(m, v, x, y)[0] for e in (1e-5, -1e-5))
        m[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3), k


def test_each_token_is_scored_once_after_what_comes_before():
    rng = np.random.default_rng(1)
    v = lm.Vocabulary(rng.integers(0, 50, 3000), rng.random(3000) < 0.5)
    m = lm.initial()
    seqs = [rng.integers(0, 2999, n) for n in (0, 1, 15, 16, 17, 130)]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got = lm.score(m, v, np.concatenate(seqs).astype(np.int64), offs, 2999, block=3)
    for s, g in zip(seqs, got, strict=True):
        t = np.append(s, 2999)
        before = np.append(2999, s)
        want = 0.0
        for i in range(len(t)):
            lo = max(0, i // lm.HALF * lm.HALF - lm.HALF)
            want += float(lm.log_probabilities(m, v, v.cls[before[lo : i + 1]][None].astype(np.int64), v.cls[t[i : i + 1]][None].astype(np.int64), 1)[0, 0]) + v.inner[t[i]]
        assert g == pytest.approx(want, rel=1e-4)
    p = np.exp(lm.log_probabilities(m, v, np.tile(v.cls[before[:5]], (lm.CLASSES, 1)).astype(np.int64), np.arange(lm.CLASSES)[:, None], 1)).sum()
    assert p == pytest.approx(1, abs=1e-3) and np.bincount(v.cls, weights=np.exp(v.inner), minlength=lm.CLASSES)[np.unique(v.cls)] == pytest.approx(1)


def test_scores(spark):
    got = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in split}
    c = Counter(w for i, ws in split.items() if not held[i] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    for i, ws in split.items():
        tokens = [*ws, None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_counts_and_windows_cover_all_texts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}q" for x in rng.zipf(1.5, n) % 500) for n in [*rng.integers(0, 90, 200), 3000]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    path = P.path("byte_bpe_50k.tiktoken")
    follows, fitted, held = [], [], []
    keep, fit = lm.Vocabulary.arrange, lm.fit
    monkeypatch.setattr(lm.Vocabulary, "arrange", lambda self, follow: (held.append(self), follows.append(follow), keep(self, follow))[2])
    monkeypatch.setattr(lm, "fit", lambda m, voc, x, y, *a, **k: (fitted.append(y), fit(m, voc, x, y, *a, **k))[1])
    lm_scoring.score(spark.read.parquet(str(tmp_path / "d")), path, P.PATTERN, "doc_id % 4 <> 1", "doc_id % 4 = 1")
    enc, end, cls = lm_scoring.bpe._encoder(path, P.PATTERN)._core_bpe.encode_ordinary, max(lm_scoring.bpe.read_ranks(path).values()) + 1, held[-1].cls
    want, classes = np.zeros((lm.CLASSES, lm.CLASSES)), []
    for i, t in enumerate(texts):
        if i % 4 != 1:
            ids = [end, *(g for w in t.split() for g in enc(" " + w)), end]
            np.add.at(want, (cls[ids[:-1]], cls[ids[1:]]), 1)
            classes += cls[ids[1:]].tolist()
    assert (follows[-1] == want).all()
    # few texts, so the first fit has all windows: each subword and end is a target once
    assert sorted(fitted[0][fitted[0] != lm.CLASSES].tolist()) == sorted(classes)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "The the THE"), (None, "x y"), (5, "word " * 5000), (6, "word " * 5000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    path = P.path("byte_bpe_50k.tiktoken")
    out = {r["doc_id"]: r for r in lm_scoring.score(df, path, P.PATTERN, "doc_id is not null", "doc_id = 5").collect()}
    assert out[1]["n_tokens"] == 1 and out[3]["n_known"] == 4 and out[5]["score"] == pytest.approx(out[6]["score"]) and out[1]["score"] == out[2]["score"]
    assert lm_scoring.score(df.limit(0), path, P.PATTERN, "true", "false").count() == 0


def test_scores_do_not_hang_on_shuffle_partitions(spark, tmp_path, monkeypatch):
    from causeway.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "CHUNKS", 2)
    monkeypatch.setattr(lm_scoring, "GROUPS", 2)  # weights are averaged in several levels
    spark.read.parquet(f"{SF}/documents.parquet").repartition(9, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = []
    try:
        for n in ("4", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(queries.op2_lm_scoring(spark, str(tmp_path)).orderBy("doc_id").toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (abs(got[0]["score"] - got[1]["score"]) <= 2e-6 * got[0]["n_tokens"]).all() and got[0].drop(columns="score").equals(got[1].drop(columns="score"))


def test_probabilities_of_large_logits_stay_below_one():
    rng = np.random.default_rng(2)
    v = lm.Vocabulary(rng.integers(0, 50, 3000), rng.random(3000) < 0.5)
    m = lm.initial()
    m["out"], m["in"] = m["out"] * 1e5, m["in"] * 1e5
    x = rng.integers(0, lm.CLASSES, (40, 2 * lm.HALF))
    got = lm.log_probabilities(m, v, x, rng.integers(0, lm.CLASSES, (40, lm.HALF)), lm.HALF)
    assert np.isfinite(got).all() and got.max() < 1e-4


def test_steps_are_plain_adam():
    """Weights in one row and sums by class in place give what the rule gives, weight by weight."""
    rng = np.random.default_rng(5)
    v = lm.Vocabulary(rng.integers(1, 100, 300), rng.random(300) < 0.5)
    x, y = (rng.integers(0, lm.CLASSES + 1, (150, 2 * lm.HALF)).astype(np.int16) for _ in range(2))
    start = {k: w.astype(np.float64) for k, w in lm.initial().items()}
    kept = {k: w.copy() for k, w in start.items()}
    got = lm.fit(start, v, x, y, 5, 0.01, size=64, seed=3)
    want, first, second = dict(kept), {k: 0.0 for k in kept}, {k: 0.0 for k in kept}
    order = np.random.default_rng(3).permutation(len(x))
    for i in range(5):
        at = order[(i * 64 + np.arange(64)) % len(x)]
        g = lm.step(want, v, x[at], y[at])[1]
        for k in want:
            first[k], second[k] = 0.9 * first[k] + 0.1 * g[k], 0.99 * second[k] + 0.01 * g[k] ** 2
            want[k] = want[k] - 0.01 * (1 - 0.9 * i / 5) * (first[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (i + 1))) + 1e-8)
    assert all(np.abs(got[k] - want[k]).max() < 1e-9 and got[k].shape == kept[k].shape for k in kept)
    assert all((start[k] == kept[k]).all() for k in kept)  # what was given stays
    for name, at in (("q", x[:, -4:]), ("k", x)):
        one = rng.normal(size=(*at.shape, lm.WIDTH))
        plain = np.zeros_like(start[name])
        for c, row in zip(at.ravel(), one.reshape(-1, lm.WIDTH), strict=True):
            plain[c] += row
        assert np.abs(lm._by_class(at.ravel(), one, 2 * one)[1] - 2 * plain).max() < 1e-9


def test_a_step_adds_up_by_class_once(monkeypatch):
    """All four vectors of a class lie in one row: one look-up and one sum a step, and the gradients of windows of which only the last places are predicted."""
    rng = np.random.default_rng(8)
    v = lm.Vocabulary(rng.integers(1, 100, 300), rng.random(300) < 0.5)
    v.groups, v.members = v.groups.astype(np.float64), v.members.astype(np.float64)
    v.flat = v.members.reshape(-1, lm.MEMBERS)
    m = {k: w.astype(np.float64) for k, w in lm.initial().items()}
    x, y = rng.integers(0, lm.CLASSES, (5, 12)), rng.integers(0, lm.CLASSES, (5, 7))
    x[0, :3], y[1, 5:] = lm.CLASSES, lm.CLASSES
    sums, keep = [], lm._sum_rows
    monkeypatch.setattr(lm, "_sum_rows", lambda at, own: (sums.append(own.shape), keep(at, own))[1])
    loss, g = lm.step(m, v, x, y)
    assert sums == [(60, 4 * lm.WIDTH)]
    assert loss == pytest.approx(-lm.log_probabilities(m, v, x, y, 7).sum() / (y != lm.CLASSES).sum())
    for k in m:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = m[k][at]
        up, down = (m[k].__setitem__(at, old + e) or lm.step(m, v, x, y)[0] for e in (1e-5, -1e-5))
        m[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3), k


def test_powers_are_bounded():
    got = lm._exp(np.array([-np.inf, 0.0, 39.0, 500.0]))
    assert got == pytest.approx(np.exp([-np.inf, 0.0, 39.0, 40.0])) and lm._exp(np.zeros((0, 3))).shape == (0, 3)
