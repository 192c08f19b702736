"""The given tables as molecules, counts and reference cells. There is no spatial table: coordinates are arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1100, 1001
GENES = 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules from lineitem."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(
        F.md5(F.concat_ws("|", *key, F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"))).alias("transcript_id"),
        (F.col("l_extendedprice") / 100).alias("x"),
        (F.col("l_quantity") * 20).alias("y"),
        F.concat(F.lit("gene_"), F.col("l_partkey") % GENES).alias("feature_name"),
        (F.col("l_orderkey") % 200).alias("cell_id"),
        F.col("l_discount").alias("qv"),
    )


def ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the reference: molecules of a customer's orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("gene_"), F.col("l_partkey") % GENES).alias("gene"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cell_id"))
    return lines.join(orders, "l_orderkey").groupBy("cell_id", "gene").agg(F.count("*").alias("count"))


def ref_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cell_type"))


def spatial_cells(cnt: DataFrame) -> DataFrame:
    """Cells of a count matrix with a type by number; every seventh has none."""
    types = F.array(*[F.lit(t) for t in SEGMENTS])
    kind = F.when(F.col("cell_id") % 7 == 0, F.lit("None_sp")).otherwise(F.element_at(types, (F.col("cell_id") % 5 + 1).cast("int")))
    return cnt.select("cell_id").distinct().withColumn("cell_type", kind)


def squares(spark: SparkSession, sf_dir: str, step: float = 50.0) -> DataFrame:
    """Cell outlines from orders: overlapping squares, one for each of 400 places that an order falls on."""
    at = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 400).alias("cell_id")).distinct()
    x, y = (F.col("cell_id") % 20) * step + 3, F.floor(F.col("cell_id") / 20) * step + 1
    corner = [F.struct((x + a * 60).alias("x"), (y + b * 60).alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    return at.select("cell_id", F.array(*corner).alias("ring"))


#: The market segments of `customer`, which stand for cell types.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

#: The same tables for DuckDB, as common table expressions.
SQL = {
    "pts": """pts AS (SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
        CAST(round(l_extendedprice * 100) AS BIGINT))) AS transcript_id, l_extendedprice / 100 AS x, l_quantity * 20 AS y,
        'gene_' || (l_partkey % 300) AS feature_name, l_orderkey % 200 AS cell_id, l_discount AS qv FROM lineitem)""",
    "cnt": """cnt AS (SELECT cell_id, feature_name AS gene, count(*) AS count FROM pts WHERE cell_id > 0 GROUP BY ALL)""",
    "tot": """tot AS (SELECT cell_id, CAST(sum(count) AS DOUBLE) AS total FROM cnt GROUP BY cell_id)""",
    "norm": """norm AS (SELECT cell_id, gene, count, ln(1 + count * (SELECT quantile_cont(total, 0.5) FROM tot) / total) AS normalized
        FROM cnt JOIN tot USING (cell_id))""",
    "stats": """stats AS (SELECT cell_id, CAST(sum(count) AS BIGINT) AS n_counts, count(*) AS n_genes FROM cnt GROUP BY cell_id)""",
    "cells": """cells AS (SELECT cell_id, CASE WHEN cell_id % 7 = 0 THEN 'None_sp' ELSE
        ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][cell_id % 5 + 1] END AS cell_type
        FROM (SELECT DISTINCT cell_id FROM cnt))""",
    "ref_cnt": """ref_cnt AS (SELECT o_custkey AS cell_id, 'gene_' || (l_partkey % 300) AS gene, count(*) AS count
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)""",
    "ref_tot": """ref_tot AS (SELECT cell_id, CAST(sum(count) AS DOUBLE) AS total FROM ref_cnt GROUP BY cell_id)""",
    "ref_norm": """ref_norm AS (SELECT cell_id, gene, count, ln(1 + count * 10000 / total) AS normalized FROM ref_cnt JOIN ref_tot USING (cell_id))""",
    "ref_cells": """ref_cells AS (SELECT c_custkey AS cell_id, c_mktsegment AS cell_type FROM customer)""",
    "squares": """squares AS (SELECT cell_id, (cell_id % 20) * 50.0 + 3 AS x0, (cell_id // 20) * 50.0 + 1 AS y0
        FROM (SELECT DISTINCT o_orderkey % 400 AS cell_id FROM orders))""",
}


def sql(names: str, query: str) -> str:
    """A query over the named common table expressions."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + " " + query.strip()
