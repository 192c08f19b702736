"""Exact and approximate nearest neighbours against brute force."""

import numpy as np
import pytest

from molgrid.operators import neighbours


def clustered(n, d, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 3
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) @ np.diag(np.linspace(1.5, 0.2, d))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(6)


def brute(x, k):
    x = x.astype(float)
    out = []
    for s in range(0, len(x), 500):
        d = np.sqrt(np.maximum((x[s : s + 500] ** 2).sum(1)[:, None] + (x**2).sum(1) - 2 * x[s : s + 500] @ x.T, 0)).round(6)
        d[np.arange(len(d)), s + np.arange(len(d))] = np.inf
        out += np.argsort(d, axis=1, kind="stable")[:, :k].tolist()
    return out


def found(df, n):
    out = [[] for _ in range(n)]
    for r in df.orderBy("src", "rank").collect():
        out[r.src].append(r.dst)
    return out


def test_recall_of_the_forest(spark):
    """12,000 clustered rows in leaves of about 190: at least nine of ten of the true neighbours."""
    x = clustered(12_000, 32, 40, 3)
    got = found(neighbours.knn(frame(spark, x), "id", "v", 10, exact_rows=0, leaf_rows=256), len(x))
    assert all(len(g) == 10 and len(set(g)) == 10 for g in got)
    hits = sum(len(set(g) & set(w)) for g, w in zip(got, brute(x, 10)))
    assert hits >= 0.9 * 10 * len(x), hits / (10 * len(x))


def test_crowded_leaves_are_dealt_out(spark, monkeypatch):
    """Blocks far smaller than the leaves change nothing."""
    x = clustered(1500, 8, 3, 4)
    whole = found(neighbours.knn(frame(spark, x), "id", "v", 4, exact_rows=0, leaf_rows=400), len(x))
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    assert found(neighbours.knn(frame(spark, x), "id", "v", 4, exact_rows=0, leaf_rows=400), len(x)) == whole


def test_blocks_follow_the_rows(spark, monkeypatch):
    x = clustered(700, 5, 4, 5)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    assert found(neighbours.knn(frame(spark, x), "id", "v", 6), len(x)) == brute(x, 6)


@pytest.mark.parametrize("exact_rows", [0, 10**6])
def test_a_third_of_all_rows_is_one_vector(spark, exact_rows):
    x = clustered(900, 6, 3, 6)
    x[::3] = x[0]
    got = found(neighbours.knn(frame(spark, x), "id", "v", 5, exact_rows=exact_rows, leaf_rows=700, trees=2), len(x))
    for i in range(0, 900, 3):
        assert got[i] == [j for j in range(0, 18, 3) if j != i][:5]
    assert all(len(g) == 5 for g in got)


def test_small_tables(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None)], "id long, v array<float>")
    for exact_rows in (0, 10):
        rows = neighbours.knn(df, "id", "v", 3, exact_rows=exact_rows).orderBy("src").collect()
        assert [(r.src, r.dst, r.distance, r.connectivity, r.rank) for r in rows] == [(1, 2, 0.0, 1.0, 1), (2, 1, 0.0, 1.0, 1)]
    assert neighbours.knn(df.where("id > 5"), "id", "v", 3).count() == 0
    assert neighbours.knn(df.where("id > 5"), "id", "v", 3, exact_rows=-1).count() == 0
