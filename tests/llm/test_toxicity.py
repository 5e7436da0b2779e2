"""Restoration against an exhaustive search, and held-out accuracy."""

from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import batch as B
from causeway.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def model(words):
    d, o = B.flat(pa.array([" ".join(words)]))
    return toxicity.language_model(toxicity.trigrams(toxicity.Lexed(d, o)))


def exhaustive(word, lm):
    """The best reading over all ways to read each character."""
    choices = []
    for t, ch in enumerate(word):
        opts, nothing = toxicity.Channel.options(ch)
        nothing = max(nothing, toxicity.Channel.again(word, t))
        choices.append([*opts, (None, nothing, "")])
    best = (-np.inf, "")
    for path in product(*choices):
        a = b = 0
        total, said = 0.0, ""
        for c, cost, ch in path:
            total += cost
            if c is not None:
                total += lm[a, b, c]
                a, b, said = b, c, said + ch
        total += lm[a, b, 0]
        best = max(best, (total, said))
    return best


def test_viterbi_is_the_best_path():
    lm = model(["idiot", "trash", "moron", "the", "stupid", "loser", "clown", "this", "that", "idle"] * 20)
    channel = toxicity.Channel(lm)
    for w in ["1d10t", "tr4$h", "m.o.r", "iiidio", "th3", "x9y", "l0s3r", "a-b", "éa1"]:
        total, said = exhaustive(w, lm)
        got = channel._viterbi([w, "the"])[0]
        assert got == said, (w, total)
    out = channel.restore([b"1d10t", b"tr4$h", b"m o r o n", b"st-up-id", b"llloooser", b"cl0wn"])
    assert [b" ".join(x) for x in out] == [b"idiot", b"trash", b"moron", b"stupid", b"loser", b"clown"]


def test_held_out_and_disguised(spark):
    got = queries.op1_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got["score"].between(0, 1).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    toxic, clean = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert (clean["predicted"] == 0).mean() > 0.97 and (toxic["predicted"] == 1).mean() > 0.6
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "true")
    base = "of the and that with this "
    rows = [(1, base + "idiot"), (2, base + "1d10t and cl0wn"), (3, base + "i d i o t " + base), (4, base + "IDIIIOT!!!"), (5, base + "w0rthl3ss."), (6, base), (7, None), (8, ""), (None, base + "m-o-r-o-n"), (10, "the " * 30000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, scorer).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0, 8: 0, None: 1, 10: 0}
    assert sorted(r["doc_id"] for r in toxicity.reject(df, scorer).collect()) == [6, 7, 8, 10]
    said = {r["doc_id"]: r["restored"] for r in toxicity.deobfuscate(df, scorer.model).collect()}
    assert said[2].endswith("idiot and clown") and said[3] == (base + "idiot " + base).strip() and said[7] == ""


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        scorer = toxicity.train(docs, own, "true")
        assert toxicity.score(docs, scorer).count() == 2
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels, "true")).count() == 0


def test_long_words_have_one_lattice():
    lm = model(["idiot", "trash", "moron", "the", "stupid", "loser", "clown", "this", "that", "idle"] * 20)
    channel = toxicity.Channel(lm)
    for n in (4000, 4090, 4093, 4094, 8189):
        got = channel.restore([b"x" * n + b".1d10t"])[0]
        assert got[-1].endswith(b"idiot"), n
    whole = channel._viterbi(["tr4$h.1d10t-l0s3r"])
    was, toxicity._STRETCH = toxicity._STRETCH, 3
    try:
        assert toxicity.Channel(lm)._viterbi(["tr4$h.1d10t-l0s3r"]) == whole == ["trash idiot loser"]
    finally:
        toxicity._STRETCH = was


def test_disguises_that_look_plain():
    lm = model(["idiot", "trash", "moron", "the", "stupid", "loser", "clown", "this", "that", "idle", "ass", "needle"] * 20)
    channel = toxicity.Channel(lm)

    def readings(text):
        of, apart = toxicity.restored(toxicity.Lexed(*B.flat(pa.array([text]))), channel)
        return sorted({w for ws in of.values() for w in ws} | {w for _, ws in apart for w in ws})

    assert readings("iiddiioott") == [b"idiot"] and readings("455") == [b"ass"] and readings("!diot") == [b"idiot"] and readings("i d ! o t") == [b"idiot"]
    assert readings("needle the idle") == [] and b"ass" not in readings("45")


def test_scores_as_brute_force(spark):
    """The noisy-or over distinct features, worked out word by word."""
    import re

    words, weights, bias = [b"idiot", b"mor*", b"moron", b"moro*", b"clow*"], np.array([2.0, 0.5, 1.0, 1.0, 0.7]), 0.05
    lm = model(["idiot", "moron", "clown", "the", "this", "idle"] * 20)
    scorer = toxicity.Scorer(lm, words, weights, bias)
    texts = ["the idiot, the IDIOT!", "morons and moronic clowns", "1d10t the", "", None, "this is idle", "moron idiot clownish the", "cl0wns"]
    named = {w.decode(): w_ for w, w_ in zip(words, weights.tolist(), strict=True)}

    def best(word):
        own = [word] + [word[:n] + "*" for n in toxicity.STEMS if len(word) > n]
        own = [(-named[x], words.index(x.encode())) for x in own if x in named]
        return {words[min(own)[1]].decode()} if own else set()

    channel = toxicity.Channel(lm)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(rows, scorer).collect()}
    for i, t in enumerate(texts):
        held = set()
        for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
            for said in channel.restore([w.encode()])[0] if re.search(r"[0-9]", w) else [w.encode()]:
                held |= best(said.decode())
        want = 1 - np.exp(-(bias + sum(named[x] for x in held)))
        assert got[i] == (pytest.approx(want), int(want >= 0.5)), t


def test_doubled_words_that_are_tried_are_those_that_matter():
    lm = model(["idiot", "trash", "moron", "the", "stupid", "loser", "clown", "needle"] * 20)
    words = [b"idiot", b"loser*", b"needle", b"cl*"]
    texts = pa.array(["iiddiioott llooserss neeedle needdle clloown", "idioot stuupid boott idiots needle", "sshe clloww ccl", ""])
    x = toxicity.Lexed(*B.flat(texts))
    channel = toxicity.Channel(lm)
    scorer = toxicity.Scorer(lm, words, np.ones(4), 0.1)
    some, _ = toxicity.restored(x, channel, toxicity.Undoubled(words)(x))
    every, _ = toxicity.restored(x, channel)
    scorer.found(*B.flat(texts))
    known = lambda of: {(i, f) for i, ws in of.items() for w in ws for f in scorer._all(w)}
    assert known(some) == known(every) and known(some)


def test_number_of_words_is_weighed(spark):
    """The weights are where the penalised likelihood is highest, and several different words weigh more than one."""
    g = np.random.default_rng(0)
    words = g.integers(0, 6, 500)
    z = g.uniform(0.5, 3, 500)
    y = (g.random(500) < np.where(words > 2, 0.95, 0.2)).astype(int)
    w = toxicity.count_weights(z, words, y)
    own = words > 0

    def loss(w):
        p = 1 / (1 + np.exp(-(toxicity._inputs(-np.expm1(-z[own]), words[own]) @ w)))
        return -(np.log(p) @ y[own] + np.log1p(-p) @ (1 - y[own])) + 0.5 * np.sum((w - [1, 0, 0, 0, 0]) ** 2)

    for i in range(len(w)):
        for d in (-1e-3, 1e-3):
            assert loss(w + d * (np.arange(len(w)) == i)) > loss(w)
    assert w[1] < 0 < w[3]
    assert toxicity.count_weights(z, words, np.ones(500, int)) is None is toxicity.count_weights(z, words * 0, y)
    lm = model(["idiot", "trash", "moron"] * 20)
    one = toxicity.Scorer(lm, [b"idio*", b"trash"], np.array([2.0, 1.0]), 0.01, np.array([1.0, -4.0, 0.0, 2.0, 3.0]))
    texts = pa.array(["idiot idiot 1d10t", "idiot idiotic", "idiot idiotic trash", "none", ""])
    got = one.scores(*B.flat(texts))
    odds = lambda p: np.log(p / (1 - p))
    stem, both, bare = (-np.expm1(-x) for x in (2.01, 3.01, 0.01))
    assert np.allclose(odds(got[:3]), [odds(stem) - 4, odds(stem), odds(both) + 2]) and np.allclose(got[3:], bare)


def test_clean_texts_are_left_alone(spark):
    """Held-out rows at sf0.1: nine of ten toxic texts caught, at most one clean text in a hundred flagged."""
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").toPandas()
    toxic, clean = got[got["toxic"] == 1], got[got["toxic"] == 0]
    assert len(toxic) > 50 and toxic["predicted"].mean() >= 0.9 and clean["predicted"].mean() <= 0.01
