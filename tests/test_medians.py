"""Exact medians by a bracket and counts."""

import numpy as np
import pytest

from molgrid.operators import geometry


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0, -1.0, 2.0, 2.0], [7.0] * 9, list(range(1001)), [0.1 * k * k for k in range(30_000)], [1e300, -1e300, 1e-300, 0.0, 4.0]])
def test_medians(spark, values):
    rng = np.random.default_rng(1)
    rows = [(float(v), float(-v)) for v in rng.permutation(values)]
    df = spark.createDataFrame([*rows, (None, None)], "a double, b double").repartition(5)
    got = geometry.medians(df, "a", "b").first()
    want = [float(np.median([r[k] for r in rows])) if rows else None for k in (0, 1)]
    assert [got.a, got.b] == pytest.approx(want) if rows else [got.a, got.b] == want


def test_no_task_holds_all_values(spark):
    """Of distinct values, only those near the middle are grouped: the exact percentile of Spark keeps each one."""
    df = spark.range(200_000).selectExpr("id * 0.37 as x", "id * 1.7 % 1000 as y")
    center = geometry.tissue_center(df, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], 10, 10)
    plan = center._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    near = geometry.medians(df, "x").first()
    assert center.first().center_x == near.x == pytest.approx(199_999 * 0.37 / 2)
