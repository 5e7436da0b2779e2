"""What is computed by classes of like models is what all pairs give, and grows with the classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway import catalog as K
from causeway.operators import alike as A
from causeway.operators import clusters as C
from causeway.operators import dyads as D
from causeway.operators import layout as L
from causeway.operators import models as M
from causeway.operators import summaries as U
from causeway.sources import events as E


@pytest.fixture(scope="module")
def given(spark):
    """72 models, many of them alike, and the scores of all pairs."""
    reg, m = E.packed(spark, "/root/testdata/sf0.001")
    one = m.orderBy("model_id").limit(9)
    m = m.unionByName(one.crossJoin(spark.range(7)).withColumn("model_id", F.concat("model_id", F.lit("x"), "id")).drop("id")).persist()
    scores = D.counts(D.pairs(m, reg), reg).select("ego_id", "alter_id", D.similarity(F.col("shared"), F.col("union_claims")).alias("score")).persist()
    of = m.select("model_id", F.when(F.col("model_id") != "0x3", F.concat(F.lit("c"), (F.xxhash64("model_id") % 3).cast("string"))).alias("cluster_id")).persist()
    return reg, m, scores, of


def table(df, digits=9):
    return sorted(tuple(round(v, digits) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def test_means(given):
    reg, m, scores, of = given
    assert table(A.of_models(m, reg)) == table(U.of_models(scores))
    assert table(A.centralities(m, reg, of).select("cluster_id", "model_id", "total", "pairs"), 6) == table(C.centralities(scores, of), 6)
    assert table(A.summaries(m, reg, of)) == table(C.summaries(scores, of))
    assert table(A.representatives(m, reg, of)) == table(C.representatives(scores, of))
    assert table(A.contrast(m, reg, of, "0", 0.3, 0.27)) == table(C.contrast(scores, of, "0", 0.3, 0.27))
    assert A.of_models(m.limit(1), reg).count() == 0 and A.summaries(m.limit(1), reg, of).first()["internal_compatibility"] == 0


@pytest.mark.parametrize("most", [5000, 3])
def test_components(given, monkeypatch, most):
    reg, m, scores, _ = given
    want = C.embed(C.profiles(scores), 3).orderBy("model_id").toPandas()[["x", "y", "z"]].to_numpy()
    embed = C.embed
    monkeypatch.setattr(C, "embed", lambda p, dims, weight: embed(p, dims, most, weight))
    got = A.embed(m, reg, 3).orderBy("model_id").toPandas()[["x", "y", "z"]].to_numpy()
    assert np.abs(got - want).max() < 1e-6


def test_sketches_and_layout(spark, given):
    reg, m, scores, _ = given
    want = {r["model_id"]: r["vec"] for r in L.sketches(C.profiles(scores), L.SKETCH, 42).collect()}
    number = m.select("model_id", F.concat_ws(",", *A.claims(reg)).alias("class")).toPandas().sort_values("model_id").reset_index(drop=True)
    assert len(number) > L.SKETCH
    rows = [(i, c, at) for at, (i, c) in enumerate(number.itertuples(index=False, name=None))]
    placed = spark.createDataFrame(rows, "model_id string, class string, i long")
    got = {r["class"]: r["vec"] for r in A.sketches(A.pairs(A.classes(m, reg), reg), placed, L.SKETCH, 42).collect()}
    assert max(np.abs(np.array(got[c]) - want[i]).max() for i, c, _ in rows) <= 1.1e-6
    assert A.umap(m, reg).count() == len(rows)


@pytest.mark.parametrize("k", [3, 15])
def test_neighbours_come_from_classes(spark, k):
    """Each model's k nearest by distance, and none that is everyone's, though hundreds lie at one point."""
    sizes, g = [400, 7, 1, 1, 30, 2], np.random.default_rng(6)
    at = g.normal(size=(len(sizes), 4))
    of = [c for c, n in enumerate(sizes) for _ in range(n)]
    number = spark.createDataFrame([(i, f"c{c}") for i, c in enumerate(of)], "i long, class string").repartition(3)
    vectors = spark.createDataFrame([(f"c{c}", v.tolist()) for c, v in enumerate(at)], "class string, vec array<double>")
    rows = A.neighbours(number, vectors, k, 1).collect()
    d = np.sqrt(((at[of][:, None] - at[of][None]) ** 2).sum(axis=2))
    assert len({(r["u"], r["v"]) for r in rows}) == len(rows) == k * len(of) and all(r["u"] != r["v"] and abs(r["d"] - d[r["u"], r["v"]]) < 1e-12 for r in rows)
    got = np.array(sorted((r["u"], r["d"]) for r in rows))[:, 1].reshape(-1, k)
    assert np.abs(got - np.sort(d + np.diag([np.inf] * len(of)), axis=1)[:, :k]).max() < 1e-12
    met = np.bincount([r["v"] for r in rows if r["d"] == 0], minlength=len(of))
    assert met.max() == k  # each place of a class is met as often as it meets others


def test_work_grows_with_classes(given):
    reg, m, _, _ = given
    of = A.classes(m, reg)
    assert of.agg(F.sum("n")).first()[0] == m.count() > of.count()
    assert A.pairs(of, reg).count() == of.count() ** 2


@pytest.mark.parametrize("name", ["cluster_summaries", "ghost_contrast", "representatives"])
def test_models_are_packed_once(spark, monkeypatch, name):
    """Clusters come from the models at hand; events are not packed again for them."""
    calls, packed = [], E.packed
    monkeypatch.setattr(E, "packed", lambda *a: calls.append(a) or packed(*a))
    assert K.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
