"""The spline surfaces against numpy, and what they gain over a quadratic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molgrid.operators import normalize


def splines(z, degree, pieces):
    """Basis by the recursion, for one axis."""
    t = np.clip(z, 0, 1) * pieces
    knots = list(range(-degree, pieces + degree + 1))
    b = [np.where((t >= k) & ((t < k + 1) | (t == pieces)) & (k + 1 <= pieces) & ((t < pieces) | (k == pieces - 1)), 1.0, 0.0) for k in knots[:-1]]
    for d in range(1, degree + 1):
        b = [(t - knots[i]) / d * b[i] + (knots[i + d + 1] - t) / d * b[i + 1] for i in range(len(b) - 1)]
    return np.stack(b, axis=1)


@pytest.fixture(scope="module")
def planted(spark):
    """Six genes whose log counts follow the library size by a bump in the tissue's middle."""
    rng = np.random.default_rng(1)
    n = 900
    x, y, depth = rng.random(n) * 500, rng.random(n) * 300, rng.normal(size=n) * 0.5
    bump = np.exp(-(((x - 250) / 60) ** 2 + ((y - 150) / 50) ** 2))
    counts = rng.poisson(np.exp(2.5 + np.outer(depth * (0.2 + 1.5 * bump), np.ones(6))))
    counts = np.column_stack([counts, rng.poisson(np.exp(5 + depth))])  # what makes the library
    rows = [(int(c), f"g{g}", int(v)) for (c, g), v in np.ndenumerate(counts) if v]
    cnt = spark.createDataFrame(rows, "cell_id long, gene string, count long").repartition(4)
    cells = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "cell_id long, x double, y double")
    return cnt, cells, x, y, counts, depth, bump


def fitted(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.cell_id, int(r.gene[1:])] = r.normalized
    return out


@pytest.mark.parametrize(("degree", "pieces"), [(1, 1), (2, 1), (3, 2)])
def test_equals_numpy(planted, degree, pieces):
    cnt, cells, x, y, counts, *_ = planted
    lib = np.log(counts.sum(axis=1))
    lib = lib - lib.mean()
    bx, by = (splines((v - v.min()) / np.ptp(v), degree, pieces) for v in (x, y))
    assert np.allclose(bx.sum(axis=1), 1)
    b = (bx[:, :, None] * by[:, None, :]).reshape(len(x), -1)
    design = np.column_stack([b, b * lib[:, None]])
    gram = design.T @ design
    beta = np.linalg.pinv(gram + 1e-3 * np.trace(gram) / len(gram) * np.eye(len(gram))) @ (design.T @ np.log1p(counts))
    want = np.maximum(0, np.log1p(counts) - lib[:, None] * (b @ beta[b.shape[1] :]))
    got = fitted(normalize.normalize_spatial(cnt, cells, degree, pieces, 1.0), counts.shape)
    assert np.allclose(got, np.where(counts > 0, want, 0), atol=1e-6)


def test_gain_over_the_quadratic(planted):
    """What is left of the library's effect in the bump: less with splines than with one quadratic piece."""
    cnt, cells, _, _, counts, depth, bump = planted
    left = {}
    for name, degree, pieces in (("quadratic", 2, 1), ("spline", 3, 4)):
        got = fitted(normalize.normalize_spatial(cnt, cells, degree, pieces, 1.0), counts.shape)[:, :6].mean(axis=1)
        inside = bump > 0.5
        left[name] = abs(np.corrcoef(got[inside], depth[inside])[0, 1])
    assert left["spline"] < 0.7 * left["quadratic"], left


def test_sampling_rule(planted):
    cnt, cells, *_ = planted
    a = normalize.normalize_spatial(cnt, cells, large=500, sample_cells=300)
    b = normalize.normalize_spatial(cnt, cells, sample_p=300 / 900)
    c = normalize.normalize_spatial(cnt, cells, sample_p=0.25)
    total = [df.agg(F.round(F.sum("normalized"), 6)).first()[0] for df in (a, b, c)]
    assert total[0] == total[1] != total[2]


def test_small_tables(spark, planted):
    cnt, cells, *_ = planted
    assert normalize.normalize_spatial(cnt.limit(0), cells).count() == 0
    one = normalize.normalize_spatial(cnt.where("cell_id = 3"), cells, sample_p=1.0)
    assert one.count() == cnt.where("cell_id = 3").count() and one.where("normalized < 0 OR normalized IS NULL").isEmpty()
