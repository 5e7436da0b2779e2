"""Layouts: exact neighbours, weights by definition, trustworthiness, and the same result however the work is dealt out."""

import numpy as np
import pytest

from causeway.operators import layout as L


def frame(spark, x, parts=3):
    return spark.createDataFrame([(f"m{i:04}", [float(v) for v in r]) for i, r in enumerate(x)], "model_id string, profile array<double>").repartition(parts)


def ring(n, seed=0):
    """A closed ribbon and a blob apart from it, in twenty dimensions."""
    g = np.random.default_rng(seed)
    t = g.uniform(0, 2 * np.pi, n)
    x = np.stack([5 * np.cos(t), 5 * np.sin(t), g.normal(0, 0.3, n)], axis=1)
    x[: n // 3] = g.normal(0, 0.7, (n // 3, 3)) + [0, 0, 12]
    return x @ np.linalg.qr(g.normal(size=(20, 20)))[0][:3]


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def trust(x, y, k):
    """Venna and Kaski's trustworthiness: neighbours in the layout that are none in the data weigh by how far they are there."""
    n = len(x)
    far = np.argsort(np.argsort(distances(x) + np.diag([-1.0] * n), axis=1), axis=1)  # a point's own rank is 0
    near = np.argsort(distances(y) + np.diag([np.inf] * n), axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(far[i, j] - k, 0) for i in range(n) for j in near[i])


def test_descent_finds_nearest_neighbours(spark):
    x = ring(300)
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "i long, vec array<double>")
    got = {(r["u"], r["v"]) for r in L.neighbours(v, 10, 1).collect()}
    d = distances(x) + np.diag([np.inf] * len(x))
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:10]}
    assert len(got) == 3000 and len(got & want) / len(want) > 0.97


def test_weights_by_definition(spark):
    g = np.random.default_rng(1)
    d = np.sort(g.uniform(0.1, 2, (12, 5)), axis=1)
    d[3] = 0
    to = np.array([g.choice([j for j in range(12) if j != i], 5, replace=False) for i in range(12)])
    graph = spark.createDataFrame([(i, int(to[i, j]), float(d[i, j])) for i in range(12) for j in range(5)], "u long, v long, d double")
    got = {(r["u"], r["v"]): r["w"] for r in L.weights(graph, 5).collect()}
    one = {}
    for i in range(12):
        gap = np.maximum(d[i] - (d[i][d[i] > 0].min() if d[i].any() else 0), 0)
        scales = np.geomspace(1e-4, 1e3, 400_000)
        s = scales[np.argmin(np.abs(np.exp(-gap[None] / scales[:, None]).sum(axis=1) - np.log2(5)))] if gap.any() else 1.0
        one |= {(i, int(to[i, j])): float(np.exp(-gap[j] / s)) for j in range(5)}
    for (u, v), w in got.items():
        a, b = one.get((u, v), 0), one.get((v, u), 0)
        assert abs(w - (a + b - a * b)) < 1e-3 and abs(got[v, u] - w) < 1e-12


def test_curve():
    a, b = L.curve(0.1, 1.0)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01


def test_layout_keeps_neighbourhoods_and_doesnt_hang_on_partitions(spark):
    x = ring(240)
    got = L.umap(frame(spark, x), seed=3).orderBy("model_id").toPandas()
    y = got[["x", "y"]].to_numpy()
    assert len(got) == 240 and np.isfinite(y).all() and trust(x, y, 10) > 0.9
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = L.umap(frame(spark, x[::-1][::-1], 5), seed=3).orderBy("model_id").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (again == got).all().all()


def test_few_and_equal_models(spark):
    assert L.umap(frame(spark, np.zeros((0, 3)))).count() == 0 and L.umap(frame(spark, np.ones((2, 3)))).count() == 2
    same = L.umap(frame(spark, np.ones((6, 3)))).toPandas()
    assert len(same) == 6 and np.isfinite(same[["x", "y"]].to_numpy()).all()
    with pytest.raises(ValueError, match="neighbours"):
        L.umap(frame(spark, np.ones((4, 3))), k=1)


@pytest.mark.parametrize("most", [1000, 10])
def test_components_of_profiles_of_any_length(spark, most):
    """Profiles needn't have a place for each model."""
    from causeway.operators import clusters as C

    for places, dims in ((20, 3), (2, 3), (60, 2)):
        x = np.random.default_rng(places).normal(size=(40, places)) * np.linspace(1, 3, places) ** 2
        got = C.embed(frame(spark, x), dims, most).orderBy("model_id").toPandas().iloc[:, 1:].to_numpy()
        u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        want = (u * s * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)]))[:, :dims]
        assert np.abs(got[:, : want.shape[1]] - want).max() < 1e-6 * np.abs(want).max() and (got[:, want.shape[1] :] == 0).all()


def test_clusters_on_the_layout(spark):
    from causeway.operators import clusters as C

    scores = spark.createDataFrame([(f"m{a:02}", f"m{b:02}", 0.9 - 0.001 * abs(a - b) if a // 15 == b // 15 else 0.1) for a in range(30) for b in range(30) if a != b], "ego_id string, alter_id string, score double")
    got = C.detect(scores, eps=3.0, min_samples=3, layout="umap").toPandas()
    assert [sorted(g["model_id"]) for _, g in got.groupby("cluster")] == [[f"m{i:02}" for i in range(15)], [f"m{i:02}" for i in range(15, 30)]]
    with pytest.raises(ValueError, match="layout"):
        C.detect(scores, layout="other")
