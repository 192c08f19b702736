"""Half of all points in one grid cell, raster row or tile: the same rows, and no task with far more of them than others."""

import pytest
from pyspark.sql import functions as F

from molgrid.operators import spatial

RING = "cell_id long, ring array<struct<x: double, y: double>>"


def square(k, x, y, size):
    return k, [{"x": x, "y": y}, {"x": x + size, "y": y}, {"x": x + size, "y": y + size}, {"x": x, "y": y + size}]


@pytest.fixture(scope="module")
def crowd(spark):
    """40,000 points; every second one in the square from (100, 100) on, the others all over."""
    hot = F.col("id") % 2 == 0
    u, v = (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(10_000)) / 10_000 for k in (1, 2))
    return spark.range(40_000).select(
        F.col("id").cast("string").alias("transcript_id"), F.when(hot, 100 + 9 * u).otherwise(1000 * u).alias("x"), F.when(hot, 100.4).otherwise(1000 * v).alias("y"), F.lit(7).alias("cell_id")
    )


@pytest.fixture(scope="module")
def poly(spark):
    return spark.createDataFrame([square(k, 37.0 * (k % 27), 37.0 * (k // 27), 50.0) for k in range(1, 700)], RING)


@pytest.fixture
def fixed_tasks(spark):
    """As many tasks as partitions, so that what each one gets can be counted."""
    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "12"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def loads(df):
    return sorted(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def assigned(how, pts, poly, rows_per_task):
    if how == "polygons":
        return spatial.assign_by_polygons(pts, poly, 64.0, 0, rows_per_task=rows_per_task)
    if how == "labels":
        return spatial.assign_by_labels(pts, spatial.rasterize(poly, 1100, 1100), 1100, 1100, rows_per_task=rows_per_task)
    return spatial.tile_points(pts, 250.0, 25.0, 20, rows_per_task=rows_per_task)


@pytest.mark.parametrize("how", ["polygons", "labels", "tiles"])
def test_no_task_has_the_crowd(fixed_tasks, crowd, poly, how):
    even = loads(assigned(how, crowd, poly, 200))
    assert len(even) == 12 and even[-1] <= 2 * even[len(even) // 2], even
    assert loads(assigned(how, crowd, poly, 10**9))[-1] > 15_000  # what it would be without


@pytest.mark.parametrize("how", ["polygons", "labels", "tiles"])
def test_the_same_rows(crowd, poly, how):
    a, b = assigned(how, crowd, poly, 200), assigned(how, crowd, poly, 10**9)
    assert a.exceptAll(b.select(*a.columns)).isEmpty() and b.exceptAll(a.select(*b.columns)).isEmpty()
    assert how == "tiles" or a.count() == 40_000


def test_polygons_by_brute_force(crowd, poly):
    got = {r.transcript_id: r.cell_id for r in spatial.assign_by_polygons(crowd, poly, 64.0, 0, rows_per_task=500).collect()}
    boxes = [(k, 37.0 * (k % 27), 37.0 * (k // 27)) for k in range(1, 700)]
    for r in crowd.where("cast(transcript_id as long) % 37 = 0").collect():
        want = next((k for k, x, y in boxes if x < r.x < x + 50 and y < r.y < y + 50), 0)
        assert got[r.transcript_id] == want
