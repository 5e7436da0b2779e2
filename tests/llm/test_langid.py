"""Language models against plain Kneser-Ney, and held-out accuracy."""

from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import langid, queries

SF = "/root/testdata/sf0.01"


def plain(words):
    """log P of an n-gram by counting in dictionaries."""
    top = Counter()
    for w in words:
        s = [1] * 3 + [ord(c) for c in w] + [2]
        for i in range(3, len(s)):
            top[tuple(s[i - 3 : i + 1])] += 1
    orders = [top]
    for _ in range(3):
        low = Counter()
        for g in orders[-1]:
            low[g[1:]] += 1
        orders.append(low)
    letters = len(orders[-1]) + 1

    def p(g, o=0):
        if o == 4:
            return 1 / max(letters, 256)
        c = orders[o]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        own = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        if not own:
            return p(g[1:], o + 1)
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:], o + 1)

    return lambda w: sum(log(p(tuple(s[i - 3 : i + 1]))) for s in [[1] * 3 + [ord(c) for c in w] + [2]] for i in range(3, len(s)))


def test_is_plain_kneser_ney():
    words = ["the", "then", "that", "tea", "the", "été", "a"]
    keys, word = langid.events(pa.array([w.encode() for w in words], pa.large_binary()))
    m = langid.Model(*langid.merge(keys, np.ones(len(keys), np.int64)))
    want = plain(words)
    for w in ["the", "théa", "xyz", "t", "eat"]:
        grams, _ = langid.events(pa.array([w.encode()], pa.large_binary()))
        assert m.log_p(grams).sum() == pytest.approx(want(w), abs=1e-9)
    total = defaultdict(float)
    for c in [*range(3, 256), 2]:
        total["sum"] += np.exp(m.log_p(np.array([(1 << 48) | (ord("t") << 32) | (ord("h") << 16) | c], np.uint64)))[0]
    assert total["sum"] <= 1.01


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == docs.count() and (held["lang_pred"] == held["lang"]).mean() > 0.95
    model = langid.train(docs, "crc32(cast(doc_id as string)) % 5 <> 0")
    rows = [(1, None), (2, ""), (3, "123 --- !!"), (4, "the of and that with"), (None, "der die und nicht"), (6, "漢字かな"), (7, "the " * 40000)]
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, lang string"), model, reject=False).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[4]["lang_pred"] == "en" == out[7]["lang_pred"] and out[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[6]["lang_pred"] in model.langs
    none = langid.train(docs.limit(0), "true")
    assert langid.identify(docs.limit(3), none).select("lang_pred").distinct().collect()[0][0] == "und"


def test_short_models_when_large(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = langid.train(docs, "true", model_bytes=1000)
    got = langid.identify(docs, small, reject=False).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.9


def test_same_models_when_large(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0")
    more = spark.createDataFrame([(-1, "\u8a00\u8a9e\u306f\u9762\u767d\u3044 \uff21\u8a00\u8a9e", "ja")], "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").union(more)
    whole, large = (langid.train(docs, "true", model_bytes=n) for n in (1 << 30, 1000))
    assert whole.langs == large.langs and whole.fit == pytest.approx(large.fit) and whole.bound == pytest.approx(large.bound)
    for a, b in zip(whole.models, large.models, strict=True):
        assert a.letters == b.letters
        for x, y in zip(a.orders, b.orders, strict=True):
            assert x[0] == y[0] and (x[1] == y[1]).all() and (x[3] == y[3]).all() and np.allclose(x[2], y[2], rtol=1e-12) and np.allclose(x[4], y[4], rtol=1e-12)
    one, two = (langid.identify(docs, m, reject=False).orderBy("doc_id").toPandas() for m in (whole, large))
    assert (one["lang_pred"] == two["lang_pred"]).all() and np.allclose(one["cross_entropy"], two["cross_entropy"], equal_nan=True)
