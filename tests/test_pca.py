"""Principal components of many features against numpy's."""

import numpy as np
import pytest

from molgrid.operators import embedding


def planted(n, d, seed):
    """Rows with ten directions of falling weight, noise, and a mean far from 0."""
    rng = np.random.default_rng(seed)
    base = np.linalg.qr(rng.normal(size=(d, 10)))[0]
    return (rng.normal(size=(n, 10)) * np.linspace(30, 6, 10)) @ base.T + rng.normal(size=(n, d)) * 0.05 + rng.normal(size=d) * 4


def exact(x, k):
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    load = vt[:k].T
    return load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)]), s[:k]


@pytest.mark.parametrize(("n", "d", "parts"), [(150, 20_000, 6), (900, 300, 7), (5, 60, 3)])
def test_leading_components(spark, n, d, parts):
    x, k = planted(n, d, n), min(6, n - 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)
    placed, load = embedding.pca(df, "id", "v", k, exact_dims=50)
    want, s = exact(x, k)
    assert load.shape == (d, k) and np.abs(load - want).max() < 1e-3
    got = np.array([r.X_pca for r in placed.orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(got, axis=0), s, rtol=1e-5)


def test_both_ways_agree(spark):
    x = planted(400, 80, 8).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(5)
    a, b = (embedding.pca(df, "id", "v", 5, exact_dims=e)[1] for e in (50, 100))
    assert np.abs(a - b).max() < 1e-4


def test_no_rows(spark):
    placed, load = embedding.pca(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 3)
    assert placed.count() == 0 and load.shape == (0, 0)
