"""Gene-gene correlations by blocks against numpy."""

import numpy as np
import pytest

from molgrid.operators import metrics


def side(spark, seed, n_cells, n_genes, density=0.3):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n_cells, n_genes)) < density, rng.random((n_cells, n_genes)) * 3, 0.0)
    x[:, 3] = 0.0
    x[:, 4] = 1.5  # constant
    x[0, 3] = 0.0
    types = ["a" if k % 3 else "b" for k in range(n_cells)]
    rows = [(int(c), f"g{g:04d}", 1, float(x[c, g])) for c, g in zip(*np.nonzero(x))]
    rows.append((0, "g0003", 0, 0.0))
    cnt = spark.createDataFrame(rows, "cell_id long, gene string, count long, normalized double").repartition(5)
    cells = spark.createDataFrame(list(enumerate(types)), "cell_id long, cell_type string")
    return (cnt, cells), x, np.array(types)


def correlations(x):
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(x, rowvar=False)
    r[:, np.ptp(x, axis=0) == 0] = np.nan
    r[np.ptp(x, axis=0) == 0] = np.nan
    return r


@pytest.mark.parametrize(("by_type", "block"), [(False, 512), (False, 7), (True, 7), (True, 20)])
def test_correlations(spark, by_type, block):
    s, x, types = side(spark, 1, 60, 41)
    got = {(r.kind, r.g, r.h): r.r for r in metrics.gene_correlations(s, by_type, block).collect()}
    want = {}
    for kind in ("a", "b") if by_type else ("all",):
        r = correlations(x[types == kind] if by_type else x)
        want |= {(kind, f"g{g:04d}", f"g{h:04d}"): r[g, h] for g in range(41) for h in range(g + 1, 41) if not np.isnan(r[g, h])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("by_type", [False, True])
def test_blocks_do_not_change_the_score(spark, by_type):
    (sp, *_), (sc, *_) = side(spark, 2, 50, 33), side(spark, 3, 80, 33)
    whole = metrics.coexpression_similarity(sp, sc, by_type).first().metric_value
    for block in (5, 16):
        assert metrics.coexpression_similarity(sp, sc, by_type, block).first().metric_value == pytest.approx(whole, abs=1e-12)


def test_five_thousand_genes(spark):
    """No task makes a matrix of all genes squared; the score is numpy's."""
    n = 5000
    (sp, x, _), (sc, y, _) = side(spark, 4, 40, n, 0.02), side(spark, 5, 40, n, 0.02)
    got = metrics.coexpression_similarity(sp, sc).first().metric_value
    there = np.intersect1d(np.flatnonzero(x.any(axis=0)), np.flatnonzero(y.any(axis=0)))
    apart = np.abs(correlations(x[:, there]) - correlations(y[:, there]))[np.triu_indices(len(there), 1)]
    assert len(there) > 1000 > metrics.BLOCK_GENES and got == pytest.approx(1 - np.nanmean(apart) / 2, abs=1e-9)


def test_kinds_of_one_side_only(spark):
    s, _, _ = side(spark, 6, 20, 9)
    other = (s[0], s[1].replace("b", "c", "cell_type"))
    assert metrics.coexpression_similarity(s, other, True).first().metric_value is not None
    none = (s[0].limit(0), s[1])
    assert metrics.coexpression_similarity(s, none).first().metric_value is None


def test_sides_are_counted_once(spark):
    """However often both sides are read, what they are made of is worked out once."""
    from pyspark.sql import functions as F

    from molgrid.operators import metrics

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rows = [(c, f"g{g}", 1, float((c * g) % 5 + 1)) for c in range(6) for g in range(4)]
    raw = spark.createDataFrame(rows, "cell_id long, gene string, count long, normalized double").coalesce(1)
    cells = spark.createDataFrame([(c, "T") for c in range(6)], "cell_id long, cell_type string")
    metrics.coexpression_similarity((raw.withColumn("normalized", counted("normalized")), cells), (raw, cells)).collect()
    assert seen.value == len(rows)
