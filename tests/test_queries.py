"""Every query with SQL gives DuckDB's rows; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__
from molgrid.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    want = sorted(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["c1_assign_by_labels", "c2_assign_by_polygons", "h2_spatial_knn", "c11_fov_neighbours", "g4_tile_points"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_crop_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["b3_crop_points_diagonal"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" in plan.split("PushedFilters")[1] or "GreaterThanOrEqual" in plan
