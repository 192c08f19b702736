"""One query for each operator over the given tables, and its SQL."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molgrid.functions import scalars as fn
from molgrid.operators import aggregate as agg
from molgrid.operators import annotate, assignment, controls, density, embedding, geometry, mapping, metrics, neighbours, normalize, sample, shapes, spatial, tables
from molgrid.plans import assembly
from molgrid.plans.bindings import GENES, HEIGHT, WIDTH, points, ref_cells, ref_counts, spatial_cells, sql, squares, table
from molgrid.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MATRIX = [[0.5, 0.1, 3.0], [-0.1, 0.5, 7.0]]
DIAGONAL = [[2.0, 0.0, -10.0], [0.0, 0.5, 5.0]]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


def _rounded(df: DataFrame, *cols: str, digits: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# whole plans -------------------------------------------------------------------------------------


@query("flow_binned_cells", sql("pts", """
, bins AS (SELECT *, CAST(floor(floor(y) / 30) * 37 + floor(floor(x) / 30) + 1 AS BIGINT) AS bin FROM pts),
c AS (SELECT bin AS cell_id, feature_name AS gene, count(*) AS count FROM bins GROUP BY ALL),
s AS (SELECT cell_id, CAST(sum(count) AS BIGINT) AS n_counts, count(*) AS n_genes FROM c GROUP BY cell_id),
m AS (SELECT bin AS cell_id, round(avg(x), 5) AS centroid_x, round(avg(y), 5) AS centroid_y FROM bins GROUP BY bin),
k AS (SELECT least(10.0, quantile_cont(n_counts, 0.2)) AS cut FROM s),
n AS (SELECT c.cell_id, sum(ln(1 + count * (SELECT quantile_cont(n_counts, 0.5) FROM s) / n_counts)) AS v FROM c JOIN s USING (cell_id) GROUP BY ALL)
SELECT cell_id, n_counts, n_genes, centroid_x, centroid_y, n_counts >= cut AS passed_QC, round(v, 4) AS sum_normalized
FROM s JOIN m USING (cell_id) JOIN n USING (cell_id), k"""))
def flow_binned_cells(spark, d):
    """Molecules to bins, counts, centroids, quality flags and normalised expression."""
    pts = spatial.assign_by_bins(points(spark, d), WIDTH, 30)
    cnt = agg.count_matrix(pts)
    cells = agg.qc_filter(agg.cell_stats(cnt).join(agg.cell_centroids(pts), "cell_id"))
    norm = normalize.normalize_by_counts(cnt).groupBy("cell_id").agg(F.round(F.sum("normalized"), 4).alias("sum_normalized"))
    return _rounded(cells, "centroid_x", "centroid_y").join(norm, "cell_id")


# projections, filters, predicates ------------------------------------------------------------------


@query("b1_standardize_obs", "SELECT c_custkey AS cell_id, c_mktsegment AS cell_type, 'drop-seq' AS assay FROM customer")
def b1(spark, d):
    return tables.standardize_obs(table(spark, d, "customer"), {"cell_id": "c_custkey", "cell_type": "c_mktsegment"}, {"assay": "drop-seq"})


@query("b2_to_global", sql("pts", "SELECT transcript_id, round(0.5 * x + 0.1 * y + 3, 5) AS gx, round(-0.1 * x + 0.5 * y + 7, 5) AS gy, round(x - 9, 5) AS x, round(y - 20, 5) AS y FROM pts"))
def b2(spark, d):
    g = geometry.to_frame(geometry.to_global(points(spark, d), MATRIX), 9.0, 20.0)
    return _rounded(g.select("transcript_id", "gx", "gy", "x", "y"), "gx", "gy", "x", "y")


@query("b3_crop_points", sql("pts", "SELECT transcript_id, x, y FROM pts WHERE 0.5 * x + 0.1 * y + 3 BETWEEN 100 AND 300 AND -0.1 * x + 0.5 * y + 7 BETWEEN 100 AND 250"))
def b3(spark, d):
    return geometry.crop_points(points(spark, d), MATRIX, (100, 100, 300, 250)).select("transcript_id", "x", "y")


@query("b3_crop_points_diagonal", sql("pts", "SELECT transcript_id FROM pts WHERE x BETWEEN 105 AND 255 AND y BETWEEN 190 AND 590"))
def b3_diagonal(spark, d):
    return geometry.crop_points(points(spark, d), DIAGONAL, (200, 100, 500, 300)).select("transcript_id")


@query("b4_crop_shapes", sql("squares", "SELECT cell_id FROM squares WHERE x0 + 30 BETWEEN 100 AND 500 AND y0 + 30 BETWEEN 200 AND 700"))
def b4(spark, d):
    unit = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    return geometry.crop_shapes(squares(spark, d), unit, (100, 200, 500, 700)).select("cell_id")


@query("b5_crop_region", sql("pts squares", "SELECT (SELECT count(*) FROM pts WHERE x BETWEEN 100 AND 500 AND y BETWEEN 200 AND 700) AS n_points, count(*) AS n_cells FROM squares WHERE x0 + 30 BETWEEN 100 AND 500 AND y0 + 30 BETWEEN 200 AND 700 "))
def b5(spark, d):
    cells = squares(spark, d).select("cell_id")
    pts, _, kept = geometry.crop_region(points(spark, d), squares(spark, d), cells, (100, 200, 500, 700))
    return pts.agg(F.count("*").alias("n_points")).crossJoin(kept.agg(F.count("*").alias("n_cells")))


@query("b6_crop_window", sql("pts", "SELECT CAST(trunc(greatest(least(quantile_cont(x, 0.5) - 200, 700), 0)) AS BIGINT) AS x, CAST(trunc(greatest(least(quantile_cont(y, 0.5) - 200, 601), 0)) AS BIGINT) AS y, CAST(400 AS BIGINT) AS w, CAST(400 AS BIGINT) AS h FROM pts"))
def b6(spark, d):
    unit = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    return geometry.crop_window(geometry.tissue_center(points(spark, d), unit, WIDTH, HEIGHT), WIDTH, HEIGHT, 160_000)


@query("b7_tissue_center", sql("pts", "SELECT round(quantile_cont(0.5 * x + 0.1 * y + 3, 0.5), 5) AS center_x, round(quantile_cont(-0.1 * x + 0.5 * y + 7, 0.5), 5) AS center_y FROM pts"))
def b7(spark, d):
    return _rounded(geometry.tissue_center(points(spark, d), MATRIX, WIDTH, HEIGHT), "center_x", "center_y")


@query("b8_filter_obs", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND NOT starts_with(o_orderpriority, '1') AND NOT ends_with(o_orderpriority, 'HIGH')")
def b8(spark, d):
    kept = tables.filter_obs(table(spark, d, "orders"), equal={"o_orderstatus": "P"}, isin={"o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"]}, not_startswith={"o_orderpriority": "1"}, not_endswith={"o_orderpriority": "HIGH"})
    return kept.select("o_orderkey", "o_orderpriority")


@query("b9_filter_groups", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)")
def b9(spark, d):
    return tables.filter_groups(table(spark, d, "orders"), "o_custkey", 12).select("o_orderkey", "o_custkey")


@query("b10_filter_genes", sql("pts cnt", "SELECT * FROM cnt WHERE gene IN (SELECT gene FROM cnt GROUP BY gene HAVING count(*) >= 60 AND sum(count) >= 150)"))
def b10(spark, d):
    return tables.filter_genes(agg.count_matrix(points(spark, d)), 60, 150).select("cell_id", "gene", "count")


@query("b11_filter_cells", sql("pts cnt", "SELECT * FROM cnt WHERE cell_id IN (SELECT cell_id FROM cnt GROUP BY cell_id HAVING count(*) >= 80 AND sum(count) >= 290)"))
def b11(spark, d):
    return tables.filter_cells(agg.count_matrix(points(spark, d)), 290, 80).select("cell_id", "gene", "count")


@query("b11_filter_paired_cells", sql("pts cnt ref_cnt", "SELECT a.cell_id, n_a, n_b FROM (SELECT cell_id, CAST(sum(count) AS BIGINT) AS n_a FROM cnt GROUP BY 1) a JOIN (SELECT cell_id, CAST(sum(count) AS BIGINT) AS n_b FROM ref_cnt GROUP BY 1) b USING (cell_id) WHERE least(n_a, n_b) > 30"))
def b11_paired(spark, d):
    return tables.filter_paired_cells(agg.count_matrix(points(spark, d)), ref_counts(spark, d), 30)


@query("b12_make_unique", "SELECT p_partkey, CASE WHEN n = 0 THEN p_brand ELSE p_brand || '-' || n END AS p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)")
def b12(spark, d):
    return tables.make_unique(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("b13_normalize_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 1 THEN 0 WHEN o_orderkey % 5 = 2 THEN 0 ELSE o_custkey END AS cell_id, CASE WHEN o_orderkey % 3 = 0 THEN 'None_sp' WHEN o_orderkey % 3 = 1 THEN 'None_sp' ELSE o_orderstatus END AS label FROM orders")
def b13(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "unassigned").when(k == 1, " none ").when(k == 2, "-1").otherwise(F.col("o_custkey").cast("string"))
    label = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 1, "None").otherwise(F.col("o_orderstatus"))
    return tables.normalize_ids(o.select("o_orderkey", raw.alias("cell_id"), label.alias("label")), label_col="label")


@query("b14_filter_confident", "SELECT l_orderkey, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= p_size / 500")
def b14(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_orderkey", "l_partkey", F.col("l_discount").alias("similarity"), (F.col("p_size") / 500).alias("threshold"))
    return tables.filter_confident(rows).select("l_orderkey", "l_partkey")


@query("b15_clip_clamp", sql("pts", "SELECT transcript_id, greatest(least(CAST(trunc(x) AS BIGINT), 499), 0) AS px, greatest(least(CAST(trunc(y) AS BIGINT), 599), 0) AS py FROM pts"))
def b15(spark, d):
    return tables.clip_to_raster(points(spark, d), 500, 600).select("transcript_id", "px", "py")


@query("b15_clip_drop", sql("pts", "SELECT transcript_id FROM pts WHERE x BETWEEN -0.5 AND 499.5 AND y BETWEEN -0.5 AND 599.5"))
def b15_drop(spark, d):
    return tables.clip_to_raster(points(spark, d), 500, 600, "drop").select("transcript_id")


@query("b15_out_of_bounds", sql("pts", "SELECT count(*) FILTER (NOT (x BETWEEN 0 AND 500 - 1e-9 AND y BETWEEN 0 AND 600 - 1e-9)) AS n_out, count(*) AS n_points FROM pts"))
def b15_out(spark, d):
    return tables.out_of_bounds(points(spark, d), 500, 600)


@query("b16_resolve_cell_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE o_orderkey END AS cell_id FROM orders")
def b16(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).alias("instance_id"), F.col("o_orderkey").alias("index"))
    return tables.resolve_cell_id(o).select("o_orderkey", "cell_id")


@query("b17_recode", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'tumor' WHEN 'BUILDING' THEN 'normal' ELSE NULL END AS status FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')")
def b17(spark, d):
    coded = tables.recode(table(spark, d, "customer"), "c_mktsegment", {"AUTOMOBILE": "tumor", "BUILDING": "normal"}, "status")
    return coded.where("status is not null").select("c_custkey", "status")


@query("b19_with_label", "SELECT c_custkey AS cell_id, 'nation_' || c_nationkey AS cell_type FROM customer")
def b19(spark, d):
    cells = table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cell_type"), F.concat(F.lit("nation_"), "c_nationkey").alias("level2"))
    return tables.with_label(cells, "level2").select("cell_id", "cell_type")


@query("b20_align_layers", sql("pts cnt ref_cnt ref_tot ref_norm", "SELECT c.cell_id, c.gene, c.count, round(normalized, 5) AS normalized FROM cnt c JOIN ref_norm n ON n.cell_id = c.cell_id AND n.gene = c.gene"))
def b20(spark, d):
    return _rounded(tables.align_layers(agg.count_matrix(points(spark, d)), normalize.log_cp(ref_counts(spark, d))), "normalized")


# joins -------------------------------------------------------------------------------------------


@query("c1_assign_by_labels", sql("pts squares", """
, px AS (SELECT transcript_id, least(greatest(CAST(trunc(x) AS BIGINT), 0), 1099) AS px, least(greatest(CAST(trunc(y) AS BIGINT), 0), 1000) AS py FROM pts),
hit AS (SELECT transcript_id, max(cell_id) AS label FROM px JOIN squares ON px >= x0 AND px < x0 + 60 AND py >= y0 AND py < y0 + 60 GROUP BY 1)
SELECT transcript_id, coalesce(label, 0) AS cell_id FROM pts LEFT JOIN hit USING (transcript_id)"""))
def c1(spark, d):
    spans = spatial.rasterize(squares(spark, d).where("cell_id > 0"), WIDTH, HEIGHT)
    return spatial.assign_by_labels(points(spark, d), spans, WIDTH, HEIGHT).select("transcript_id", "cell_id")


_POLYGON_SQL = """
, hit AS (SELECT transcript_id, min(squares.cell_id) AS cell FROM pts JOIN squares ON x > x0 AND x < x0 + 60 AND y > y0 AND y < y0 + 60 GROUP BY 1)
SELECT transcript_id, %s AS cell_id FROM pts LEFT JOIN hit USING (transcript_id)"""


@query("c2_assign_by_polygons", sql("pts squares", _POLYGON_SQL % "CAST(cell AS VARCHAR)"))
def c2(spark, d):
    return spatial.assign_by_polygons(points(spark, d), squares(spark, d), 64.0).select("transcript_id", F.col("cell_id").cast("string").alias("cell_id"))


@query("c3_assign_unassigned", sql("pts squares", _POLYGON_SQL % "coalesce(cell, -1)"))
def c3(spark, d):
    return spatial.assign_by_polygons(points(spark, d), squares(spark, d), 64.0, -1).select("transcript_id", "cell_id")


@query("c4_attach_volume", sql("pts cnt stats", "SELECT cell_id, n_counts, n_counts * 2.0 AS volume FROM stats"))
def c4(spark, d):
    cells = agg.cell_stats(agg.count_matrix(points(spark, d))).select("cell_id", "n_counts")
    return tables.attach_volume(cells, cells.select("cell_id", (F.col("n_counts") * 2.0).alias("volume")))


@query("c5_attach_qc", sql("pts cnt stats cells", "SELECT cell_id, cell_type, CASE WHEN n_counts > 300 THEN n_counts ELSE 0 END AS n_counts FROM cells LEFT JOIN stats USING (cell_id)"))
def c5(spark, d):
    cnt = agg.count_matrix(points(spark, d))
    return tables.attach(spatial_cells(cnt), agg.cell_stats(cnt).where("n_counts > 300").select("cell_id", "n_counts")).na.fill(0, ["n_counts"])


@query("c6_attach_annotation", sql("pts cnt", "SELECT c.cell_id, n_genes, c_mktsegment AS cell_type FROM (SELECT cell_id, count(*) AS n_genes FROM cnt GROUP BY 1) c LEFT JOIN customer ON c_custkey = c.cell_id AND c_nationkey < 20"))
def c6(spark, d):
    meta = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cell_type"))
    return tables.attach(agg.cell_stats(agg.count_matrix(points(spark, d))).select("cell_id", "n_genes"), meta)


@query("c7_restrict", sql("pts cnt", "SELECT * FROM cnt WHERE gene IN (SELECT 'gene_' || p_partkey FROM part WHERE p_size < 20)"))
def c7(spark, d):
    genes = table(spark, d, "part").where("p_size < 20").select(F.concat(F.lit("gene_"), "p_partkey").alias("gene"))
    return tables.restrict(agg.count_matrix(points(spark, d)), genes).select("cell_id", "gene", "count")


@query("c8_complete_cells", "SELECT c_custkey AS cell_id, count(o_orderkey) AS count FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def c8(spark, d):
    n = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("cell_id")).agg(F.count("*").alias("count"))
    return tables.complete_cells(n, ref_cells(spark, d)).select("cell_id", "count")


@query("c9_apply_assignment", sql("pts", "SELECT transcript_id, CASE WHEN qv > 0.05 THEN cell_id + 1 ELSE 0 END AS cell_id FROM pts"))
def c9(spark, d):
    pts = points(spark, d)
    part = pts.where("qv > 0.05").select("transcript_id", (F.col("cell_id") + 1).alias("cell_id"))
    return tables.apply_assignment(pts, part).select("transcript_id", "cell_id")


@query("c10_merge_layer", sql("pts cnt", "SELECT cell_id, gene, CASE WHEN cell_id % 3 = 0 AND count > 1 THEN count * 10 ELSE count END AS count FROM cnt"))
def c10(spark, d):
    cnt = agg.count_matrix(points(spark, d))
    patch = cnt.where("cell_id % 3 = 0 and count > 1").withColumn("count", F.col("count") * 10)
    return tables.merge_layer(cnt, patch).select("cell_id", "gene", "count")


@query("c11_fov_neighbours", """WITH f AS (SELECT DISTINCT o_custkey AS fov, (o_custkey % 40) * 90.0 AS x, (o_custkey // 40) * 90.0 AS y FROM orders)
SELECT a.fov AS a, b.fov AS b, CASE WHEN a.y = b.y THEN 'right' WHEN a.x = b.x THEN 'bottom' ELSE 'diagonal' END AS side
FROM f a, f b WHERE a.fov != b.fov AND b.x - a.x >= 0 AND b.x - a.x < 100 AND abs(b.y - a.y) < 100 AND (b.x > a.x OR b.y > a.y)""")
def c11(spark, d):
    k = F.col("o_custkey")
    fovs = table(spark, d, "orders").select(k.alias("fov"), ((k % 40) * 90.0).alias("x"), (F.floor(k / 40) * 90.0).alias("y")).distinct()
    return spatial.fov_neighbours(fovs, 100.0)


@query("c12_with_fallback", sql("pts", "SELECT transcript_id, CASE WHEN qv > 0.05 THEN cell_id + 1000 ELSE cell_id END AS cell_id FROM pts"))
def c12(spark, d):
    pts = points(spark, d)
    refined = pts.where("qv > 0.05").select("transcript_id", (F.col("cell_id") + 1000).alias("cell_id"))
    return tables.with_fallback(refined, pts).select("transcript_id", "cell_id")


@query("c13_assert_cells", sql("pts cnt stats", "SELECT (SELECT count(DISTINCT cell_id) FROM pts WHERE cell_id > 0) AS n_ids, count(*) AS n_cells FROM stats"))
def c13(spark, d):
    pts = points(spark, d)
    return tables.assert_cells(pts, agg.cell_stats(agg.count_matrix(pts)))


# aggregations ------------------------------------------------------------------------------------


@query("d1_count_matrix", sql("pts cnt", "SELECT * FROM cnt"))
def d1(spark, d):
    return agg.count_matrix(points(spark, d))


@query("d2_cell_centroids", sql("pts", "SELECT cell_id, round(avg(x), 5) AS centroid_x, round(avg(y), 5) AS centroid_y FROM pts WHERE cell_id > 0 GROUP BY 1"))
def d2(spark, d):
    return _rounded(agg.cell_centroids(points(spark, d)), "centroid_x", "centroid_y")


@query("d3_cell_stats", sql("pts cnt stats", "SELECT * FROM stats"))
def d3(spark, d):
    return agg.cell_stats(agg.count_matrix(points(spark, d)))


@query("d4_gene_stats", sql("pts cnt", "SELECT gene, CAST(sum(count) AS BIGINT) AS n_counts, count(*) AS n_cells FROM cnt GROUP BY gene"))
def d4(spark, d):
    return agg.gene_stats(agg.count_matrix(points(spark, d)))


@query("d5_pct_noise", sql("pts", "SELECT round(avg(CAST(cell_id <= 0 AS DOUBLE)), 8) AS pct_noise FROM pts"))
def d5(spark, d):
    return _rounded(agg.pct_noise(points(spark, d)), "pct_noise", digits=8)


@query("d6_to_wide", sql("pts cnt", "SELECT cell_id, " + ", ".join(f"CAST(coalesce(sum(count) FILTER (gene = 'gene_{k}'), 0) AS BIGINT) AS gene_{k}" for k in range(GENES)) + " FROM cnt GROUP BY cell_id"))
def d6(spark, d):
    return agg.to_wide(agg.count_matrix(points(spark, d)), [f"gene_{k}" for k in range(GENES)])


@query("d7_explode_counts", sql("pts cnt", "SELECT row_number() OVER (ORDER BY cell_id, feature_name, nth) - 1 AS transcript_id, * FROM (SELECT cell_id, gene AS feature_name, unnest(range(1, count + 1)) AS nth, CAST(cell_id AS DOUBLE) AS x FROM cnt)"))
def d7(spark, d):
    return agg.explode_counts(agg.count_matrix(points(spark, d))).select("transcript_id", "cell_id", "feature_name", "nth", "x")


@query("d8_assigned_cells", sql("pts", "SELECT DISTINCT cell_id FROM pts WHERE cell_id != 0"))
def d8(spark, d):
    return agg.assigned_cells(points(spark, d))


@query("d9_qc_filter", sql("pts cnt stats", "SELECT cell_id, n_counts, n_counts >= (SELECT least(310.0, quantile_cont(n_counts, 0.2)) FROM stats) AS passed_QC FROM stats"))
def d9(spark, d):
    return agg.qc_filter(agg.cell_stats(agg.count_matrix(points(spark, d))), 310).select("cell_id", "n_counts", "passed_QC")


@query("d12_rasterize", sql("squares", "SELECT CAST(count(*) AS BIGINT) AS pixels, count(DISTINCT label) AS labels FROM (SELECT px, py, max(cell_id) AS label FROM range(1100) a(px), range(1001) b(py), squares WHERE cell_id > 0 AND px >= x0 AND px < x0 + 60 AND py >= y0 AND py < y0 + 60 GROUP BY 1, 2)"))
def d12(spark, d):
    spans = spatial.rasterize(squares(spark, d).where("cell_id > 0"), WIDTH, HEIGHT)
    return spans.agg(F.sum(F.col("x_end") - F.col("x_start") + 1).alias("pixels"), F.count_distinct("label").alias("labels"))


@query("d14_extent", sql("pts", "SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM pts"))
def d14(spark, d):
    return geometry.extent(points(spark, d))


@query("d15_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def d15(spark, d):
    return agg.value_counts(table(spark, d, "events"), "event_type")


@query("d16_majority_label", """WITH n AS (SELECT l_orderkey % 200 AS cell_id, l_returnflag || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY cell_id) AS t FROM n)
SELECT cell_id, label, round(n / t, 8) AS share FROM r WHERE k = 1""")
def d16(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("cell_id"), F.concat("l_returnflag", "l_linestatus").alias("label"))
    return _rounded(agg.majority_label(rows), "share", digits=8)


# sampling ----------------------------------------------------------------------------------------


@query("e1_dedupe_first", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def e1(spark, d):
    return agg.dedupe_first(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query("e2_factorize", sql("pts", "SELECT transcript_id, dense_rank() OVER (ORDER BY feature_name) AS code FROM pts"))
def e2(spark, d):
    return sample.factorize(points(spark, d), "feature_name").select("transcript_id", "code")


@query("e3_argmax_label", """WITH s AS (SELECT o_custkey AS cell_id, o_orderpriority AS label, max(o_totalprice) AS score FROM orders GROUP BY ALL)
SELECT cell_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, label) AS n FROM s) WHERE n = 1""")
def e3(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell_id"), F.col("o_orderpriority").alias("label")).agg(F.max("o_totalprice").alias("score"))
    return agg.argmax_label(s)


@query("e4_balanced_subsample", """WITH s AS (SELECT c_nationkey AS k, count(*) AS size FROM customer GROUP BY 1),
a AS (SELECT *, row_number() OVER (ORDER BY size, k) - 1 AS pos, sum(size) OVER (ORDER BY size, k) - size AS before, count(*) OVER () AS g FROM s),
w AS (SELECT *, size * (g - pos) + before <= 100 AS whole FROM a),
p AS (SELECT min(pos) AS p, min(before) AS taken FROM w WHERE NOT whole),
q AS (SELECT k, CASE WHEN whole THEN size ELSE (100 - taken) // (g - p) + CASE WHEN pos - p < (100 - taken) % (g - p) THEN 1 ELSE 0 END END AS quota FROM w, p)
SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, quota, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('3|' || c_custkey)) AS n FROM customer JOIN q ON k = c_nationkey) WHERE n <= quota""")
def e4(spark, d):
    return sample.balanced_subsample(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 100, 3)


@query("e5_subsample", "SELECT event_id, user_id FROM events ORDER BY md5('11|' || event_id) LIMIT 500")
def e5(spark, d):
    return sample.subsample(table(spark, d, "events").select("event_id", "user_id"), "event_id", 500, 11)


_U = "((CAST('0x' || substr(md5('5|' || event_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


@query("e6_subsample_even", f"SELECT event_id, event_type FROM events JOIN (SELECT event_type, count(*) AS s FROM events GROUP BY 1) USING (event_type) ORDER BY ln({_U}) / (1.0 / s) DESC, event_id LIMIT 400")
def e6(spark, d):
    return sample.subsample_even(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 400, 5)


@query("e7_subsample_weighted", f"SELECT event_id, event_type FROM events JOIN (SELECT event_type, count(*) AS s FROM events GROUP BY 1) USING (event_type) ORDER BY ln({_U}) / (sqrt(s) / s) DESC, event_id LIMIT 400")
def e7(spark, d):
    return sample.subsample_weighted(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 400, 5)


@query("e8_subsample_features", sql("pts", "SELECT gene FROM (SELECT DISTINCT feature_name AS gene FROM pts) LEFT JOIN (SELECT DISTINCT 'gene_' || p_partkey AS k FROM part WHERE p_size = 7) ON k = gene ORDER BY k IS NULL, md5('2|' || gene) LIMIT 60"))
def e8(spark, d):
    keep = table(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("gene_"), "p_partkey").alias("gene"))
    return sample.subsample_features(points(spark, d).select(F.col("feature_name").alias("gene")), keep, 60, 2)


@query("e9_permute_column", """WITH a AS (SELECT c_custkey AS cell_id, row_number() OVER (ORDER BY c_custkey) AS n FROM customer),
b AS (SELECT c_mktsegment AS cell_type, row_number() OVER (ORDER BY md5('9|' || c_custkey)) AS n FROM customer) SELECT cell_id, cell_type FROM a JOIN b USING (n)""")
def e9(spark, d):
    return sample.permute_column(ref_cells(spark, d), "cell_type", "cell_id", 9)


@query("e10_subsample_dataset", sql("ref_cnt ref_cells", """, ch AS (SELECT cell_id, cell_type FROM ref_cells JOIN (SELECT cell_type, count(*) AS s FROM ref_cells WHERE cell_type IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY 1) USING (cell_type)
  ORDER BY ln((CAST('0x' || substr(md5('4|' || cell_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / (1.0 / s) DESC, cell_id LIMIT 90),
l AS (SELECT * FROM ref_cnt WHERE cell_id IN (SELECT cell_id FROM ch)), c AS (SELECT * FROM l WHERE cell_id IN (SELECT cell_id FROM l GROUP BY 1 HAVING sum(count) >= 2))
SELECT cell_id, gene, count, cell_type FROM c JOIN ch USING (cell_id) WHERE gene IN (SELECT gene FROM c GROUP BY 1 HAVING count(*) >= 3)"""))
def e10(spark, d):
    cnt, cells = sample.subsample_dataset(ref_counts(spark, d), ref_cells(spark, d), "cell_type", ["BUILDING", "MACHINERY", "FURNITURE"], 90, 4, 2, 3)
    return cnt.join(cells, "cell_id")


@query("a12_row_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS transcript_id FROM orders")
def a12(spark, d):
    return sample.with_row_id(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", name="transcript_id").select("o_orderkey", "transcript_id")


# sets --------------------------------------------------------------------------------------------


@query("s1_shared_genes", sql("pts", "SELECT DISTINCT feature_name AS gene FROM pts INTERSECT SELECT 'gene_' || (p_partkey * 7 % 400) FROM part"))
def s1(spark, d):
    genes = table(spark, d, "part").select(F.concat(F.lit("gene_"), F.col("p_partkey") * 7 % 400).alias("gene"))
    return tables.shared_genes(points(spark, d).select(F.col("feature_name").alias("gene")), genes)


@query("s2_missing_ids", "SELECT CAST(i AS BIGINT) AS o_custkey FROM range(1200) t(i) WHERE i NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def s2(spark, d):
    return tables.missing_ids(table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey", 1200)


@query("s3_concat_counts", sql("pts cnt ref_cnt", "SELECT cell_id, gene, count FROM (SELECT * FROM cnt UNION ALL SELECT * FROM ref_cnt) WHERE gene IN (SELECT gene FROM cnt INTERSECT SELECT gene FROM ref_cnt)"))
def s3(spark, d):
    return tables.concat_counts([agg.count_matrix(points(spark, d)), ref_counts(spark, d)]).select("cell_id", "gene", "count")


@query("s4_assert_overlap", sql("pts cnt cells", "SELECT DISTINCT cell_type FROM cells WHERE cell_type != 'None_sp' INTERSECT SELECT c_mktsegment FROM customer"))
def s4(spark, d):
    return tables.assert_overlap(spatial_cells(agg.count_matrix(points(spark, d))), ref_cells(spark, d))


# scalar functions ----------------------------------------------------------------------------------


@query("f_scalars", """SELECT o_orderkey, ln(1 + o_orderkey) AS log1p, CAST(trunc(o_totalprice / 7) AS BIGINT) AS pixel,
greatest(least(o_orderkey, 900), 100) AS clamped, replace(o_orderpriority || '/x', '/', '_') AS label, o_custkey AS suffix, o_custkey AS fov,
round((o_orderkey * 1.5 + 2.25) / 2, 5) AS mean_of_list FROM orders""")
def f_scalars(spark, d):
    k = F.col("o_orderkey")
    listed = F.concat_ws(",", (k * 1.5).cast("string"), F.lit("2.25"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.log1p(k.cast("double")).alias("log1p"), fn.pixel(F.col("o_totalprice") / 7).alias("pixel"), fn.clamp(k, 100, 900).alias("clamped"),
        fn.file_label(F.concat("o_orderpriority", F.lit("/x"))).alias("label"), fn.composite_suffix(F.concat(F.lit("CR-a-"), "o_custkey")).alias("suffix"),
        fn.leading_number(F.concat(F.lit("fov_000"), "o_custkey"), "fov_").alias("fov"),
        F.round(F.aggregate(fn.numbers(listed), F.lit(0.0), lambda a, x: a + x) / 2, 5).alias("mean_of_list"),
    )


@query("a14_sidecar_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS major FROM events")
def a14(spark, d):
    return table(spark, d, "events").select("event_id", fn.software_major(F.col("props"), "$.k").alias("major"))


# bins and tiles ------------------------------------------------------------------------------------


@query("g1_assign_by_bins", sql("pts", "SELECT transcript_id, CAST(floor(floor(y) / 25) * 44 + floor(floor(x) / 25) + 1 AS BIGINT) AS cell_id FROM pts"))
def g1(spark, d):
    return spatial.assign_by_bins(points(spark, d), WIDTH, 10, 5.3, 0.2125).select("transcript_id", "cell_id")


@query("g3_sweep_bins", sql("pts", """, b AS (SELECT s AS bin_size, floor(floor(y) / s) * ceil(1100 / s) + floor(floor(x) / s) AS bin, count(*) AS n FROM pts, (VALUES (20), (30), (40)) t(s) GROUP BY 1, 2)
SELECT bin_size, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS n_molecules, max(n) AS largest FROM b GROUP BY 1"""))
def g3(spark, d):
    return spatial.sweep_bins(points(spark, d), [20, 30, 40], WIDTH)


@query("g4_tile_points", sql("pts", """, t AS (SELECT transcript_id, tx AS tile_x, ty AS tile_y FROM pts, range(-1, 6) a(tx), range(-1, 6) b(ty)
WHERE tx BETWEEN floor((x - 25) / 250) AND floor((x + 25) / 250) AND ty BETWEEN floor((y - 25) / 250) AND floor((y + 25) / 250))
SELECT tile_x, tile_y, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 20"""))
def g4(spark, d):
    return spatial.tile_points(points(spark, d), 250.0, 25.0, 20).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"))


# normalisation -----------------------------------------------------------------------------------


@query("n1_normalize_by_counts", sql("pts cnt tot norm", "SELECT cell_id, gene, round(normalized, 5) AS normalized FROM norm"))
def n1(spark, d):
    return _rounded(normalize.normalize_by_counts(agg.count_matrix(points(spark, d))).select("cell_id", "gene", "normalized"), "normalized")


@query("n2_normalize_by_volume", sql("pts cnt", """, v AS (SELECT cell_id, 1.0 + cell_id % 13 AS volume FROM (SELECT DISTINCT cell_id FROM cnt))
SELECT cell_id, gene, round(ln(1 + count * (SELECT quantile_cont(volume, 0.5) FROM v) / volume), 5) AS normalized FROM cnt JOIN v USING (cell_id)"""))
def n2(spark, d):
    cnt = agg.count_matrix(points(spark, d))
    vol = cnt.select("cell_id").distinct().withColumn("volume", 1.0 + F.col("cell_id") % 13)
    return _rounded(normalize.normalize_by_volume(cnt, vol).select("cell_id", "gene", "normalized"), "normalized")


@query("n3_log_cp", sql("ref_cnt ref_tot ref_norm", "SELECT cell_id, gene, round(normalized, 5) AS normalized FROM ref_norm"))
def n3(spark, d):
    return _rounded(normalize.log_cp(ref_counts(spark, d)).select("cell_id", "gene", "normalized"), "normalized")


@query("n5_renormalize", sql("pts cnt tot norm", """, f AS (SELECT cell_id, sum(count) / sum(exp(normalized) - 1) AS f FROM norm GROUP BY 1)
SELECT cell_id, gene, round(ln(1 + 0.9 * count / f), 5) AS renormalized FROM norm JOIN f USING (cell_id)"""))
def n5(spark, d):
    norm = normalize.normalize_by_counts(agg.count_matrix(points(spark, d))).withColumn("corrected", F.col("count") * 0.9)
    return _rounded(normalize.renormalize(norm).select("cell_id", "gene", "renormalized"), "renormalized")


@query("n6_log_norm_counts", sql("pts cnt tot", "SELECT cell_id, gene, round(log2(count / (total / (SELECT avg(total) FROM tot)) + 1), 5) AS log_norm FROM cnt JOIN tot USING (cell_id)"))
def n6(spark, d):
    return _rounded(normalize.log_norm_counts(agg.count_matrix(points(spark, d))).select("cell_id", "gene", "log_norm"), "log_norm")


@query("n7_no_correction", sql("pts cnt tot norm", "SELECT cell_id, gene, round(normalized, 5) AS normalized_uncorrected FROM norm"))
def n7(spark, d):
    norm = normalize.no_correction(normalize.normalize_by_counts(agg.count_matrix(points(spark, d))))
    return _rounded(normalize.no_correction(norm).select("cell_id", "gene", "normalized_uncorrected"), "normalized_uncorrected")


_PROFILES = """, ref_p AS (SELECT cell_type, gene, sum(v) / any_value(n) AS mean, count(*) / any_value(n) AS rate FROM (SELECT cell_id, gene, {ref} AS v FROM {ref_t})
  JOIN ref_cells USING (cell_id) JOIN (SELECT cell_type, count(*) AS n FROM ref_cells GROUP BY 1) USING (cell_type) GROUP BY 1, 2),
sp_p AS (SELECT cell_type, gene, sum(v) / any_value(n) AS mean, count(*) / any_value(n) AS rate FROM (SELECT cell_id, gene, {sp} AS v FROM {sp_t})
  JOIN cells USING (cell_id) JOIN (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1) USING (cell_type) WHERE cell_type != 'None_sp' GROUP BY 1, 2)"""
_BOTH = "pts cnt tot norm cells ref_cnt ref_tot ref_norm ref_cells"
_BY_NORM = _PROFILES.format(ref="normalized", ref_t="ref_norm", sp="normalized", sp_t="norm")
_BY_COUNT = _PROFILES.format(ref="count", ref_t="ref_cnt", sp="count", sp_t="cnt")


@query("n9_gene_efficiency", sql(_BOTH, _BY_NORM + """, e AS (SELECT coalesce(s.gene, r.gene) AS gene, sum(s.mean) / sum(r.mean) AS e
FROM sp_p s FULL JOIN ref_p r ON s.gene = r.gene AND s.cell_type = r.cell_type GROUP BY 1)
SELECT cell_id, norm.gene, round(CASE WHEN e > 0 THEN normalized / e ELSE normalized END, 5) AS corrected FROM norm LEFT JOIN e ON e.gene = norm.gene"""))
def n9(spark, d):
    sp = normalize.normalize_by_counts(agg.count_matrix(points(spark, d)))
    out = normalize.gene_efficiency(sp, spatial_cells(sp), normalize.log_cp(ref_counts(spark, d)), ref_cells(spark, d))
    return _rounded(out.select("cell_id", "gene", "corrected"), "corrected")


# reference ---------------------------------------------------------------------------------------


@query("k0_type_profiles", sql(_BOTH, _BY_COUNT + "SELECT cell_type, gene, round(mean, 6) AS mean, round(rate, 6) AS rate FROM ref_p"))
def k0(spark, d):
    p = annotate.type_profiles(ref_counts(spark, d), ref_cells(spark, d)).select("cell_type", "gene", "mean", "rate")
    return _rounded(p, "mean", "rate", digits=6)


@query("k1_hvg", sql("ref_cnt ref_tot ref_norm ref_cells", """, n AS (SELECT count(*) AS n FROM ref_cells),
s AS (SELECT gene, sum(normalized) AS s, sum(normalized ** 2) AS q FROM ref_norm GROUP BY 1),
v AS (SELECT gene, s / n AS mean, (q - n * (s / n) ** 2) / (n - 1) / (s / n) AS dispersion FROM s, n),
b AS (SELECT *, ntile(20) OVER (ORDER BY mean, gene) AS bin FROM v),
m AS (SELECT bin, quantile_cont(dispersion, 0.5) AS med FROM b GROUP BY 1),
a AS (SELECT bin, quantile_cont(abs(dispersion - med), 0.5) AS mad FROM b JOIN m USING (bin) GROUP BY 1)
SELECT gene, round(CASE WHEN mad > 0 THEN (dispersion - med) / mad ELSE 0 END, 4) AS hvg_score FROM b JOIN m USING (bin) JOIN a USING (bin)"""))
def k1(spark, d):
    return _rounded(annotate.hvg(normalize.log_cp(ref_counts(spark, d)), ref_cells(spark, d), 50).select("gene", "hvg_score"), "hvg_score", digits=4)


_CORRELATION = """, total AS (SELECT cell_id, sum(count) AS t FROM cnt GROUP BY 1),
g AS (SELECT gene FROM cnt INTERSECT SELECT gene FROM ref_p),
x AS (SELECT cell_id, gene, log2(1 + count * 1e6 / t) AS x FROM cnt JOIN total USING (cell_id) WHERE gene IN (SELECT gene FROM g)),
y AS (SELECT cell_type, gene, log2(1 + mean * 1e6 / sum(mean) OVER (PARTITION BY cell_type)) AS y FROM ref_p WHERE gene IN (SELECT gene FROM g)),
full_ AS (SELECT c.cell_id, t.cell_type AS label, g.gene, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT DISTINCT cell_id FROM cnt) c, (SELECT DISTINCT cell_type FROM ref_p) t, g
  LEFT JOIN x ON x.cell_id = c.cell_id AND x.gene = g.gene LEFT JOIN y ON y.cell_type = t.cell_type AND y.gene = g.gene),
r AS (SELECT cell_id, label, round(corr(x, y), 9) AS score FROM full_ GROUP BY 1, 2)
SELECT cell_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, label) AS k FROM r) WHERE k = 1"""


@query("k4_annotate_correlation", sql(_BOTH, _BY_COUNT + _CORRELATION))
def k4(spark, d):
    profile = annotate.type_profiles(ref_counts(spark, d), ref_cells(spark, d))
    return _rounded(annotate.annotate_correlation(agg.count_matrix(points(spark, d)), profile), "score", digits=6)


@query("k9_de_genes", sql(_BOTH, _BY_COUNT + """, r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY mean DESC, cell_type DESC) AS k, lead(mean, 1, 0) OVER (PARTITION BY gene ORDER BY mean DESC, cell_type DESC) AS rest FROM ref_p)
SELECT cell_type, gene, round(mean, 6) AS mean, round(ln(mean + 1e-9) - ln(rest + 1e-9), 5) AS log_fc FROM r WHERE k = 1 AND mean > 0.1 AND ln(mean + 1e-9) - ln(rest + 1e-9) >= 0.05"""))
def k9(spark, d):
    found = annotate.de_genes(annotate.type_profiles(ref_counts(spark, d), ref_cells(spark, d)), 0.1, 0.05)
    return _rounded(_rounded(found, "mean", digits=6), "log_fc")


# metrics -----------------------------------------------------------------------------------------


def _sides(spark, d):
    sp = normalize.normalize_by_counts(agg.count_matrix(points(spark, d)))
    return (sp, spatial_cells(sp)), (normalize.log_cp(ref_counts(spark, d)), ref_cells(spark, d))


@query("m1_assigned_reads", sql("pts", "SELECT 'proportion_of_assigned_reads' AS metric_id, round(avg(CAST(cell_id > 0 AS DOUBLE)), 8) AS metric_value FROM pts"))
def m1(spark, d):
    return _rounded(metrics.assigned_reads(points(spark, d)), "metric_value", digits=8)


@query("m1_assigned_reads_by_gene", sql("pts", "SELECT feature_name AS gene, round(avg(CAST(cell_id > 0 AS DOUBLE)), 8) AS proportion FROM pts GROUP BY 1"))
def m1_gene(spark, d):
    return _rounded(metrics.assigned_reads_by_gene(points(spark, d)), "proportion", digits=8)


@query("m2_annotated_cells", sql("pts cnt cells", "SELECT 'proportion_of_annotated_cells' AS metric_id, round(avg(CAST(cell_type != 'None_sp' AS DOUBLE)), 8) AS metric_value FROM cells"))
def m2(spark, d):
    return _rounded(metrics.annotated_cells(spatial_cells(agg.count_matrix(points(spark, d)))), "metric_value", digits=8)


@query("m3_n_cells", sql("pts cnt stats", "SELECT 'number_of_cells' AS metric_id, CAST(count(*) AS DOUBLE) AS metric_value FROM stats"))
def m3(spark, d):
    return metrics.n_cells(agg.cell_stats(agg.count_matrix(points(spark, d))))


_NEGATIVE = """, g AS (SELECT gene FROM cnt INTERSECT SELECT gene FROM ref_cnt),
neg AS (SELECT t.cell_type, g.gene FROM (SELECT cell_type FROM ref_cells GROUP BY 1 HAVING count(*) >= 10) t, g LEFT JOIN ref_p r ON r.cell_type = t.cell_type AND r.gene = g.gene WHERE coalesce(rate, 0) < 0.11)"""


@query("m4_neg_marker_purity_reads", sql(_BOTH, _BY_COUNT + _NEGATIVE + """, q AS (SELECT cell_type, gene, mean / sum(mean) OVER (PARTITION BY gene) AS v FROM sp_p), r AS (SELECT cell_type, gene, mean / sum(mean) OVER (PARTITION BY gene) AS v FROM ref_p)
SELECT 'neg_marker_purity_reads' AS metric_id, round(1 - greatest(0, avg(coalesce(q.v, 0)) - avg(coalesce(r.v, 0))), 6) AS metric_value FROM neg LEFT JOIN q ON q.cell_type = neg.cell_type AND q.gene = neg.gene LEFT JOIN r ON r.cell_type = neg.cell_type AND r.gene = neg.gene"""))
def m4(spark, d):
    return _rounded(metrics.neg_marker_purity_reads(*_sides(spark, d), 0.11), "metric_value", digits=6)


@query("m5_neg_marker_purity_cells", sql(_BOTH, _BY_COUNT + _NEGATIVE + """
SELECT 'neg_marker_purity_cells' AS metric_id, round(1 - greatest(0, avg(coalesce(q.rate, 0)) - avg(coalesce(r.rate, 0))), 6) AS metric_value FROM neg LEFT JOIN sp_p q ON q.cell_type = neg.cell_type AND q.gene = neg.gene LEFT JOIN ref_p r ON r.cell_type = neg.cell_type AND r.gene = neg.gene"""))
def m5(spark, d):
    return _rounded(metrics.neg_marker_purity_cells(*_sides(spark, d), 0.11), "metric_value", digits=6)


def _coexpression_sql(kind: str, of: str, name: str) -> str:
    def side(cnt: str, cells: str, keep: str) -> str:
        return f"""SELECT kind, a.gene AS g, b.gene AS h, corr(a.v, b.v) AS r FROM f_{cnt} a JOIN f_{cnt} b USING (kind, cell_id) WHERE a.gene < b.gene GROUP BY ALL HAVING stddev_pop(a.v) > 1e-9 AND stddev_pop(b.v) > 1e-9"""
    full = ", ".join(f"""f_{n} AS (SELECT {k} AS kind, c.cell_id, g.gene, coalesce(normalized, 0) AS v FROM {cells} c, g LEFT JOIN {n} n ON n.cell_id = c.cell_id AND n.gene = g.gene WHERE c.cell_type != 'None_sp')""" for n, cells, k in (("norm", "cells", kind), ("ref_norm", "ref_cells", kind)))
    return f""", g AS (SELECT gene FROM cnt INTERSECT SELECT gene FROM ref_cnt), {full},
ra AS ({side('norm', 'cells', '')}), rb AS ({side('ref_norm', 'ref_cells', '')}),
v AS (SELECT kind, 1 - avg(abs(ra.r - rb.r)) / 2 AS v FROM ra JOIN rb USING (kind, g, h) GROUP BY 1)
SELECT '{name}' AS metric_id, round(avg(v), 6) AS metric_value FROM v"""


@query("m6_coexpression_similarity", sql(_BOTH, _coexpression_sql("'all'", "", "coexpression_similarity")))
def m6(spark, d):
    return _rounded(metrics.coexpression_similarity(*_sides(spark, d)), "metric_value", digits=6)


@query("m7_coexpression_similarity_celltype", sql(_BOTH, _coexpression_sql("c.cell_type", "", "coexpression_similarity_celltype")))
def m7(spark, d):
    return _rounded(metrics.coexpression_similarity(*_sides(spark, d), by_type=True), "metric_value", digits=6)


def _relative_sql(name: str, across: str, along: str) -> str:
    def side(p: str) -> str:
        return f"""SELECT *, v / nullif(sum(abs(v)) OVER (PARTITION BY l), 0) AS s FROM (SELECT a.{along} AS l, a.{across} AS x, b.{across} AS y, a.m - b.m AS v FROM f_{p} a JOIN f_{p} b ON a.{along} = b.{along} AND a.{across} < b.{across})"""
    full = ", ".join(f"""f_{p} AS (SELECT t.cell_type, g.gene, coalesce(mean, 0) AS m FROM (SELECT DISTINCT cell_type FROM sp_p) t, g LEFT JOIN {p} p ON p.cell_type = t.cell_type AND p.gene = g.gene)""" for p in ("sp_p", "ref_p"))
    return f""", g AS (SELECT gene FROM cnt INTERSECT SELECT gene FROM ref_cnt), {full}, a AS ({side('sp_p')}), b AS ({side('ref_p')}),
v AS (SELECT l, 1 - sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2 AS v FROM a JOIN b USING (l, x, y) GROUP BY 1) SELECT '{name}' AS metric_id, round(avg(v), 6) AS metric_value FROM v"""


@query("m8_relative_celltype_similarity", sql(_BOTH, _BY_NORM + _relative_sql("rel_pairwise_ct_expr_sim", "cell_type", "gene")))
def m8(spark, d):
    return _rounded(metrics.relative_celltype_similarity(*_sides(spark, d)), "metric_value", digits=6)


@query("m9_relative_gene_similarity", sql(_BOTH, _BY_NORM + _relative_sql("rel_pairwise_gene_expr_sim", "gene", "cell_type")))
def m9(spark, d):
    return _rounded(metrics.relative_gene_similarity(*_sides(spark, d)), "metric_value", digits=6)


def _all_metrics_sql() -> str:
    """The six scores, and the same on the cells, counts and values that pass the quality filter."""
    names = ("m4_neg_marker_purity_reads", "m5_neg_marker_purity_cells", "m6_coexpression_similarity", "m7_coexpression_similarity_celltype", "m8_relative_celltype_similarity", "m9_relative_gene_similarity")
    common = sql(_BOTH, "")
    passed = """, n_counts AS (SELECT cell_id, sum(count) AS n FROM cnt GROUP BY 1),
passed AS (SELECT cell_id FROM n_counts WHERE n >= (SELECT least(10.0, quantile_cont(n, 0.2)) FROM n_counts)), """
    passed += ", ".join(f"{t}_q AS (SELECT * FROM {t} WHERE cell_id IN (SELECT cell_id FROM passed))" for t in ("cnt", "norm", "cells"))
    parts = []
    for name in names:
        body = ORACLE[name].removeprefix(common)
        parts += [f"SELECT metric_id, metric_value FROM ({common}{body})", f"SELECT metric_id || '_qc_filtered', metric_value FROM ({common}{passed}{re.sub(r'\b(cnt|norm|cells)\b', r'\1_q', body)})"]
    return "\nUNION ALL\n".join(parts)


@query("m11_all_metrics", _all_metrics_sql())
def m11(spark, d):
    sp, sc = _sides(spark, d)
    flags = agg.qc_filter(agg.cell_stats(sp[0])).select("cell_id", "passed_QC")
    return _rounded(metrics.all_metrics((sp[0], tables.attach(sp[1], flags)), sc, 0.11), "metric_value", digits=6)


@query("m12_collect_scores", "SELECT o_custkey AS run_id, o_orderstatus AS dataset_id, unnest(['n', 'total']) AS metric_id, unnest([CAST(count(*) AS DOUBLE), round(sum(o_totalprice), 2)]) AS metric_value FROM orders GROUP BY 1, 2")
def m12(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("dataset_id")).agg(
        F.array(F.lit("n"), F.lit("total")).alias("metric_ids"), F.array(F.count("*").cast("double"), F.round(F.sum("o_totalprice"), 2)).alias("metric_values")
    )
    return metrics.collect_scores(runs)


# controls ----------------------------------------------------------------------------------------


@query("x1_control_identity", sql("ref_cnt ref_cells", "SELECT cell_id, cell_type, CAST(coalesce(sum(count), 0) AS BIGINT) AS n_counts, count(gene) AS n_genes, 1.0 AS volume, true AS passed_QC FROM ref_cells LEFT JOIN ref_cnt USING (cell_id) GROUP BY 1, 2"))
def x1(spark, d):
    out = controls.control_identity(ref_counts(spark, d), ref_cells(spark, d))["cells"]
    return out.select("cell_id", "cell_type", "n_counts", "n_genes", "volume", "passed_QC")


@query("x2_control_permuted", """WITH a AS (SELECT c_custkey AS cell_id, row_number() OVER (ORDER BY c_custkey) AS n FROM customer),
b AS (SELECT c_mktsegment AS cell_type, row_number() OVER (ORDER BY md5('5|' || c_custkey)) AS n FROM customer),
k AS (SELECT o_custkey AS cell_id, count(*) AS n_counts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT cell_id, cell_type, coalesce(n_counts, 0) AS n_counts FROM a JOIN b USING (n) LEFT JOIN k USING (cell_id)""")
def x2(spark, d):
    return controls.control_permuted(ref_counts(spark, d), ref_cells(spark, d), 5)["cells"].select("cell_id", "cell_type", "n_counts")


@query("x3_process_dataset", sql("pts squares ref_cnt", "SELECT 'transcripts' AS part, transcript_id AS id FROM pts WHERE x BETWEEN 100 AND 700 AND y BETWEEN 100 AND 800 AND feature_name IN (SELECT gene FROM ref_cnt) UNION ALL SELECT 'polygons', CAST(cell_id AS VARCHAR) FROM squares WHERE x0 + 30 BETWEEN 100 AND 700 AND y0 + 30 BETWEEN 100 AND 800"))
def x3(spark, d):
    out = controls.process_dataset(points(spark, d), squares(spark, d), ref_counts(spark, d), ref_cells(spark, d), 200, (100, 100, 700, 800), 1)
    rows = [out[k].select(F.lit(k).alias("part"), F.col(i).cast("string").alias("id")) for k, i in (("transcripts", "transcript_id"), ("polygons", "cell_id"))]
    return rows[0].unionByName(rows[1])


_X3_GENES = "SELECT p_partkey % 300 AS gene_id, 'gene_' || (p_partkey % 300 - p_partkey % 2) AS gene FROM part GROUP BY 1, 2"


@query("x3_process_dataset_reference", sql("pts ref_cells", f"""
, names AS (SELECT gene_id, CASE WHEN n = 0 THEN gene ELSE gene || '-' || n END AS gene FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY gene_id) - 1 AS n FROM ({_X3_GENES}))),
r AS (SELECT o_custkey AS cell_id, l_partkey % 300 AS gene_id, count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT cell_id, gene, count FROM r JOIN names USING (gene_id) WHERE gene IN (SELECT feature_name FROM pts)"""))
def x3_reference(spark, d):
    """Counts of the reference by gene ids whose names repeat; names are made unique, then genes are shared. All cells fit."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % GENES).alias("gene_id"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cell_id"))
    cnt = lines.join(orders, "l_orderkey").groupBy("cell_id", "gene_id").agg(F.count("*").alias("count"))
    k = F.col("p_partkey")
    genes = table(spark, d, "part").select((k % GENES).alias("gene_id"), F.concat(F.lit("gene_"), k % GENES - k % 2).alias("gene")).distinct()
    cells = ref_cells(spark, d)
    return controls.process_dataset(points(spark, d), squares(spark, d), cnt, cells, cells.count(), (100, 100, 700, 800), 1, ref_genes=genes)["ref_counts"].select("cell_id", "gene", "count")


@query("x3_process_dataset_metadata", """SELECT 'brain' AS dataset_id, n_name AS dataset_name, 'url' AS dataset_url, CAST(n_nationkey AS VARCHAR) AS orig_dataset_id, 'kept' AS other FROM nation""")
def x3_metadata(spark, d):
    """Each nation's row as metadata: keys are overwritten, an `orig_` column that is there keeps the old value."""
    meta = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("dataset_id"), F.col("n_name").alias("dataset_name"), F.lit("old").alias("orig_dataset_id"), F.lit("kept").alias("other")
    )
    out = controls.process_dataset(points(spark, d), squares(spark, d), ref_counts(spark, d), ref_cells(spark, d), 200, (100, 100, 700, 800), 1, meta=meta, params={"dataset_id": "brain", "dataset_url": "url"})
    return out["metadata"].select("dataset_id", "dataset_name", "dataset_url", "orig_dataset_id", "other")


@query("x3_process_dataset_labels", sql("pts squares", """
, m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM pts),
w AS (SELECT CAST(trunc(least(greatest(mx - 300, 0), 500)) AS BIGINT) AS wx, CAST(trunc(least(greatest(my - 300, 0), 401)) AS BIGINT) AS wy FROM m),
s AS (SELECT squares.* FROM squares, w WHERE x0 + 30 BETWEEN wx AND wx + 600 AND y0 + 30 BETWEEN wy AND wy + 600)
SELECT label, count(*) AS pixels FROM (SELECT px, py, max(cell_id) AS label FROM range(1100) a(px), range(1001) b(py), s WHERE cell_id > 0 AND px >= x0 AND px < x0 + 60 AND py >= y0 AND py < y0 + 60 GROUP BY 1, 2) GROUP BY 1"""))
def x3_labels(spark, d):
    """The crop is a window around the tissue's middle; its outlines are drawn as labels."""
    pts, poly = points(spark, d), squares(spark, d).where("cell_id > 0")
    out = controls.process_dataset(pts, poly, ref_counts(spark, d), ref_cells(spark, d), 200, None, 1, (WIDTH, HEIGHT), 600 * 600)
    return out["labels"].groupBy("label").agg(F.sum(F.col("x_end") - F.col("x_start") + 1).alias("pixels"))


# kernels: no SQL equivalent, held against numpy in the tests --------------------------------------------


def _profile(spark, d):
    return annotate.type_profiles(ref_counts(spark, d), ref_cells(spark, d))


@query("d10_cell_hulls", sql("pts", """, c AS (SELECT DISTINCT cell_id, y, x FROM (SELECT cell_id, y, unnest([min(x), max(x)]) AS x FROM pts WHERE cell_id != 0 GROUP BY 1, 2)),
e AS (SELECT a.cell_id, a.x AS ax, a.y AS ay, b.x AS ux, b.y AS uy FROM c a JOIN c b ON a.cell_id = b.cell_id AND (a.x, a.y) != (b.x, b.y) JOIN c p ON p.cell_id = a.cell_id GROUP BY ALL
  HAVING min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) >= 0
  AND max(CASE WHEN (b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) THEN (p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) ELSE 0 END) <= 0)
SELECT cell_id, count(*) AS corners, round(sum(ax * uy - ux * ay) / 2, 4) AS area FROM e GROUP BY 1 HAVING count(*) > 2"""))
def d10(spark, d):
    return shapes.cell_hulls(points(spark, d)).select("cell_id", F.size("ring").cast("long").alias("corners"), F.round(geometry.ring_area(F.col("ring")), 4).alias("area"))


@query("d11_cell_volumes")
def d11(spark, d):
    return _rounded(shapes.cell_volumes(points(spark, d)), "volume", digits=4)


@query("d11_cell_volumes_alpha")
def d11_alpha(spark, d):
    """Triangles with a circumradius of under 25 only."""
    return _rounded(shapes.cell_volumes(points(spark, d), 0.04), "volume", digits=4)


@query("d13_labels_to_polygons", sql("squares", "SELECT label AS cell_id, CAST(count(*) AS DOUBLE) AS area FROM (SELECT px, py, max(cell_id) AS label FROM range(1100) a(px), range(1001) b(py), squares WHERE cell_id > 0 AND px >= x0 AND px < x0 + 60 AND py >= y0 AND py < y0 + 60 GROUP BY 1, 2) GROUP BY 1"))
def d13(spark, d):
    """Overlapping squares: where larger labels lie on top, the outline goes around what is left."""
    rings = shapes.labels_to_polygons(spatial.rasterize(squares(spark, d).where("cell_id > 0"), WIDTH, HEIGHT))
    return rings.select("cell_id", F.round(geometry.ring_area(F.col("ring")), 4).alias("area"))


@query("k2_pca")
def k2(spark, d):
    placed, _ = embedding.pca(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return placed.select("vec_id", F.transform("X_pca", lambda v: F.round(v, 5)).alias("X_pca"))


@query("k3_knn", "SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 7), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id QUALIFY rank <= 5")
def k3(spark, d):
    return neighbours.knn(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("src", "dst", "rank")


@query("k3_knn_approximate")
def k3_approximate(spark, d):
    """By the forest whatever the row count; tests hold its recall against the exact way."""
    return neighbours.knn(table(spark, d, "embeddings"), "vec_id", "embedding", 5, exact_rows=0, leaf_rows=256).select("src", "dst", "rank")


@query("k5_annotate_spearman")
def k5(spark, d):
    return _rounded(mapping.annotate_spearman(agg.count_matrix(points(spark, d)), normalize.log_cp(ref_counts(spark, d)), ref_cells(spark, d)), "score")


@query("k6_annotate_ot")
def k6(spark, d):
    return _rounded(mapping.annotate_ot(agg.count_matrix(points(spark, d)), _profile(spark, d), ref_cells(spark, d)), "score")


@query("k6_annotate_nnls")
def k6_nnls(spark, d):
    return _rounded(mapping.annotate_weights(agg.count_matrix(points(spark, d)), _profile(spark, d)), "score")


@query("k6_annotate_projection", sql(_BOTH, _BY_COUNT + """, g AS (SELECT gene FROM cnt INTERSECT SELECT gene FROM ref_p),
p AS (SELECT * FROM ref_p WHERE gene IN (SELECT gene FROM g)), x AS (SELECT * FROM cnt WHERE gene IN (SELECT gene FROM g)),
pn AS (SELECT cell_type, sqrt(sum(mean ** 2)) AS n FROM p GROUP BY 1), xn AS (SELECT cell_id, sqrt(sum(count ** 2)) AS n FROM x GROUP BY 1),
d AS (SELECT cell_id, cell_type, sum(count * mean) AS d FROM x JOIN p USING (gene) GROUP BY 1, 2),
r AS (SELECT c.cell_id, pn.cell_type AS label, round(coalesce(d / (xn.n * pn.n), 0), 9) AS score FROM (SELECT DISTINCT cell_id FROM cnt) c CROSS JOIN pn
  LEFT JOIN xn ON xn.cell_id = c.cell_id LEFT JOIN d ON d.cell_id = c.cell_id AND d.cell_type = pn.cell_type)
SELECT cell_id, label, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, label) AS k FROM r) WHERE k = 1"""))
def k6_projection(spark, d):
    return _rounded(mapping.annotate_weights(agg.count_matrix(points(spark, d)), _profile(spark, d), "projection"), "score")


def _decomposed(spark, d):
    cnt, profile = agg.count_matrix(points(spark, d)), _profile(spark, d)
    return cnt, profile, mapping.decompose(cnt, profile, annotate.de_genes(profile, 0.0, 0.02), ref_cells=ref_cells(spark, d))


@query("k7_decompose")
def k7(spark, d):
    return _rounded(_decomposed(spark, d)[2], "first_weight", "second_weight")


@query("k8_annotate_density")
def k8(spark, d):
    return _rounded(density.annotate_density(points(spark, d), _profile(spark, d), step=8.0, bandwidth=8.0), "share")


@query("n4_normalize_spatial")
def n4(spark, d):
    pts = points(spark, d)
    cells = agg.cell_centroids(pts).select("cell_id", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    return _rounded(normalize.normalize_spatial(agg.count_matrix(pts), cells), "normalized")


@query("n8_purify_counts")
def n8(spark, d):
    cnt, profile, pairs = _decomposed(spark, d)
    return _rounded(normalize.purify_counts(cnt, pairs, profile), "purified")


@query("h1_probabilistic_assign")
def h1(spark, d):
    pts = points(spark, d)
    cells = squares(spark, d).select((F.col("cell_id") + 1).alias("cell_id"), (F.col("ring")[0]["x"] + 30).alias("x"), (F.col("ring")[0]["y"] + 30).alias("y"))
    return _rounded(assignment.probabilistic_assign(pts, cells, _profile(spark, d)), "prob", "cell_type_prob", digits=4)


@query("h2_spatial_knn", sql("pts squares", """, c AS (SELECT cell_id AS id, x0 + 30 AS x, y0 + 30 AS y FROM squares)
SELECT transcript_id AS id, id AS neighbour, row_number() OVER (PARTITION BY transcript_id ORDER BY sqrt((pts.x - c.x) ** 2 + (pts.y - c.y) ** 2), id) AS rank
FROM pts JOIN c ON (pts.x - c.x) ** 2 + (pts.y - c.y) ** 2 <= 10000 QUALIFY rank <= 2"""))
def h2(spark, d):
    cells = squares(spark, d).select(F.col("cell_id").alias("id"), (F.col("ring")[0]["x"] + 30).alias("x"), (F.col("ring")[0]["y"] + 30).alias("y"))
    return spatial.spatial_knn(points(spark, d).select(F.col("transcript_id").alias("id"), "x", "y"), cells, 2, 100.0).select("id", "neighbour", "rank")


def _scored(spark, d):
    pts = points(spark, d)
    return assignment.score_transcripts(pts, spatial_cells(agg.count_matrix(pts)).where("cell_type != 'None_sp'"), _profile(spark, d), -0.2)


@query("h3_score_transcripts", sql(_BOTH, _BY_COUNT + """, lp AS (SELECT t.cell_type, g.gene, ln(coalesce(mean, 0) / s + 1e-5) AS l FROM (SELECT cell_type, sum(mean) AS s FROM ref_p GROUP BY 1) t, (SELECT DISTINCT gene FROM ref_p) g LEFT JOIN ref_p r ON r.cell_type = t.cell_type AND r.gene = g.gene),
sc AS (SELECT cell_type, gene, l - max(l) OVER (PARTITION BY gene) AS s FROM lp)
SELECT transcript_id, round(s, 5) AS score FROM pts JOIN cells USING (cell_id) JOIN sc ON sc.cell_type = cells.cell_type AND sc.gene = feature_name"""))
def h3(spark, d):
    return _rounded(_scored(spark, d).select("transcript_id", "score"), "score")


@query("h4_trim_assignment", ORACLE["h3_score_transcripts"].split("SELECT transcript_id, round(s, 5)")[0].rstrip() + """, f AS (SELECT CASE WHEN s <= -0.2 THEN 0 ELSE pts.cell_id END AS c FROM pts JOIN cells USING (cell_id) JOIN sc ON sc.cell_type = cells.cell_type AND sc.gene = feature_name),
big AS (SELECT c FROM f WHERE c > 0 GROUP BY 1 HAVING count(*) >= 5)
SELECT CASE WHEN c IN (SELECT c FROM big) THEN c ELSE 0 END AS cell_id, count(*) AS n FROM f GROUP BY 1""")
def h4(spark, d):
    return assignment.trim_assignment(_scored(spark, d), 5).groupBy("cell_id").agg(F.count("*").alias("n"))


@query("m10_knn_mixing")
def m10(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("cell_type"))
    return _rounded(embedding.knn_mixing(e.where("id % 2 = 0"), e.where("id % 2 = 1"), 15, 10), "metric_value", digits=4)


@query("a11_export_xenium", sql("pts", "SELECT transcript_id, CASE WHEN cell_id = 0 THEN 'UNASSIGNED' ELSE CAST(cell_id AS VARCHAR) END AS cell_id, CAST(cell_id > 0 AS INTEGER) AS overlaps_nucleus FROM pts"))
def a11(spark, d):
    return writers.xenium_transcripts(points(spark, d)).select("transcript_id", "cell_id", F.col("overlaps_nucleus").cast("int").alias("overlaps_nucleus"))


def _file(df: DataFrame, name: str, fmt: str = "csv") -> str:
    """The path of `df` written in a vendor's format in the shared folder."""
    path = writers.shared_path(df.sparkSession, name)
    writers.write_table(df, path, fmt)
    return path


@query("a1_read_xenium", sql("pts", "SELECT CAST('0x' || md5(transcript_id)[1:12] AS BIGINT) AS transcript_id, x, feature_name, CASE WHEN cell_id > 0 THEN CAST(cell_id AS VARCHAR) END AS cell_id, cell_id > 0 AS overlaps_nucleus FROM pts"))
def a1(spark, d):
    """The molecules in the vendor's layout, written and read back; ids are numbers there."""
    number = F.conv(F.substring(F.md5("transcript_id"), 1, 12), 16, 10).cast("long")
    path = _file(writers.xenium_transcripts(points(spark, d).withColumn("transcript_id", number)), "xenium", "parquet")
    return readers.read_xenium_points(spark, path).select("transcript_id", "x", "feature_name", "cell_id", "overlaps_nucleus")


@query("a2_read_cosmx", """SELECT l_orderkey % 9 AS fov, CASE WHEN l_orderkey % 200 > 0 THEN (l_orderkey % 9) * ((SELECT max(l_orderkey % 200) FROM lineitem) + 1) + l_orderkey % 200 ELSE 0 END AS cell_id, 'gene_' || (l_partkey % 300) AS feature_name, l_extendedprice AS x, l_quantity AS y FROM lineitem""")
def a2(spark, d):
    k = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select(
        (k % 9).alias("fov"), (k % 200).alias("cell_ID"), F.concat(F.lit("gene_"), F.col("l_partkey") % GENES).alias("target"),
        F.col("l_extendedprice").alias("x_global_px"), F.col("l_quantity").alias("y_global_px"), F.lit(0.0).alias("z"),
    )
    return readers.read_cosmx_points(spark, _file(rows, "cosmx")).select("fov", "cell_id", "feature_name", "x", "y")


@query("a5_read_merscope", sql("pts cnt", "SELECT CAST(cell_id AS VARCHAR) AS cell_id, gene, count FROM cnt WHERE cell_id IN (SELECT o_orderkey FROM orders)"))
def a5(spark, d):
    """Counts in one column for each gene; the metadata have the cells that are order keys too."""
    pts = points(spark, d)
    molecules = pts.select(F.col("feature_name").alias("gene"), F.lit(0).alias("global_z"), "transcript_id", "x", "y")
    wide = agg.to_wide(agg.count_matrix(pts), [f"gene_{k}" for k in range(GENES)])
    cells = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).distinct()
    return readers.read_merscope(spark, _file(molecules, "merscope-points"), _file(wide, "merscope-counts"), _file(cells, "merscope-cells"))[1]


@query("a7_read_abca_spots", sql("pts", "SELECT CAST(CAST(trunc(1100 - x / 0.5) AS BIGINT) AS DOUBLE) AS x, CAST(CAST(trunc(y / 0.5) AS BIGINT) AS DOUBLE) AS y, feature_name FROM pts"))
def a7(spark, d):
    spots = points(spark, d).select(F.col("x").alias("global_x"), F.col("y").alias("global_y"), F.lit(0.0).alias("global_z"), F.col("feature_name").alias("target_gene"))
    return readers.read_abca_spots(spark, _file(spots, "abca"), 1100.0, 0.5).select("x", "y", "feature_name")


@query("a8_read_mtx_obs", "SELECT CAST(c_custkey AS VARCHAR) AS cell, c_mktsegment AS cell_type FROM customer")
def a8_obs(spark, d):
    """Cells and their metadata in two files of the same order, without a key in common."""
    cells = ref_cells(spark, d).orderBy("cell_id")
    obs, names = _file(cells.select("cell_type"), "obs"), _file(cells.select(F.col("cell_id").cast("string")), "barcodes", "text")
    return readers.read_mtx_obs(spark, obs, names)


@query("a10_write_table", sql("ref_cells", "SELECT cell_id, cell_type FROM ref_cells"))
def a10(spark, d):
    path = writers.shared_path(spark, "table")
    writers.write_table(ref_cells(spark, d), path, partition_by=("cell_type",))
    return spark.read.parquet(path).select("cell_id", "cell_type")


_LABEL = "p_brand || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '_' END || p_size AS label"


@query("f9_label_names", f"""WITH p AS (SELECT p_partkey, {_LABEL} FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY replace(label, '/', '_') ORDER BY label) - 1 AS n FROM (SELECT DISTINCT label FROM p))
SELECT p_partkey, replace(label, '/', '_') || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS name, label AS back FROM p JOIN n USING (label)""")
def f9(spark, d):
    """Labels as names of files, no two alike, and back."""
    rows = table(spark, d, "part").selectExpr("p_partkey", _LABEL)
    names = tables.label_names(rows, "label")
    named = rows.join(names, "label").select("p_partkey", "name", F.col("name").alias("back"))
    return tables.restore_labels(named, "back", names)


@query("b18_assert_labels", ORACLE["d12_rasterize"])
def b18(spark, d):
    spans = tables.assert_labels(spatial.rasterize(squares(spark, d).where("cell_id > 0"), WIDTH, HEIGHT))
    return spans.agg(F.sum(F.col("x_end") - F.col("x_start") + 1).alias("pixels"), F.count_distinct("label").alias("labels"))


@query("g2_use_labels", ORACLE["c1_assign_by_labels"])
def g2(spark, d):
    spans = spatial.use_labels({"cells": spatial.rasterize(squares(spark, d).where("cell_id > 0"), WIDTH, HEIGHT)}, "cells")
    return spatial.assign_by_labels(points(spark, d), spans, WIDTH, HEIGHT).select("transcript_id", "cell_id")


@query("a3_rebuild_cosmx", """WITH c AS (SELECT l_orderkey % 9 AS fov, l_orderkey % 200 AS cell FROM lineitem), s AS (SELECT DISTINCT o_orderkey % 9 AS fov, o_orderkey % 250 AS cell FROM orders),
m AS (SELECT max(cell) + 1 AS m FROM (SELECT cell FROM c WHERE fov < 8 UNION ALL SELECT cell FROM s WHERE fov < 8)), n AS (SELECT fov, cell, count(*) AS n FROM c WHERE cell > 0 GROUP BY ALL)
SELECT fov, CASE WHEN cell > 0 THEN fov * m + cell ELSE 0 END AS cell_id, round(fov * 150.0 + cell, 4) AS centroid_x, round(fov * 50.0 + 999 - cell / 2, 4) AS centroid_y, coalesce(n, 0) AS n_counts
FROM s CROSS JOIN m LEFT JOIN n USING (fov, cell) WHERE fov < 8""")
def a3(spark, d):
    """A folder of files for each field of view; the ninth has no position. Positions stand twice in their file."""
    k = F.col("l_orderkey")
    calls = table(spark, d, "lineitem").select((k % 9).alias("n"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.lit(0.0).alias("z"), F.concat(F.lit("gene_"), F.col("l_partkey") % GENES).alias("target"), (k % 200).alias("CellId"))
    c = F.col("o_orderkey")
    stats = table(spark, d, "orders").select((c % 9).alias("n"), (c % 250).alias("CellId"), (c % 250).cast("double").alias("CenterX"), ((c % 250) / 2).alias("CenterY"), F.lit(9.0).alias("Area")).distinct()
    zero = F.lit(0)
    at = table(spark, d, "orders").select((c % 9).alias("n")).where("n < 8").groupBy("n").agg(F.lit(1)).select((F.col("n") * 1.5).alias("x"), (F.col("n") * 0.5).alias("y"), zero.alias("a"), zero.alias("b"), zero.alias("c"), "n")
    fields = writers.shared_path(spark, "fields")
    at.unionByName(at).write.csv(fields)

    def by_field(rows: DataFrame, name: str) -> list[str]:
        base = writers.shared_path(spark, name)
        paths = [f"{base}/FOV_{n:03d}" for n in range(9)]
        for n, path in enumerate(paths):
            writers.write_table(rows.where(F.col("n") == n).drop("n"), path, "csv")
        return paths

    _, meta, _ = readers.rebuild_cosmx(spark, by_field(calls, "calls"), fields, by_field(stats, "stats"), 100.0, 1000)
    return _rounded(meta.select("fov", "cell_id", "centroid_x", "centroid_y", "n_counts"), "centroid_x", "centroid_y", digits=4)


@query("a9_read_dense_matrix", sql("ref_cnt", "SELECT CAST(cell_id AS VARCHAR) AS cell, gene, count FROM ref_cnt"))
def a9(spark, d):
    """Genes in rows, cells in columns, a header line: written as text and read back, against the cells' annotation."""
    cnt = writers.written(ref_counts(spark, d), "dense-counts")
    cells = sample.with_row_id(cnt.select("cell_id").distinct(), "cell_id", name="at")
    wide = F.broadcast(cells.agg(F.count("*").cast("int").alias("wide")))
    found = cnt.join(cells, "cell_id").groupBy("gene").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "count"))).alias("m")).crossJoin(wide)

    def after_zeros(x: F.Column, k: F.Column) -> F.Column:
        before = F.coalesce(F.get("m", k - 1)["at"], F.lit(-1))
        return F.concat(F.repeat(F.lit("0\t"), x["at"] - before - 1), x["count"].cast("string"))

    rest = F.repeat(F.lit("\t0"), F.col("wide") - 1 - F.element_at("m", -1)["at"])
    body = found.select(F.lit(1).alias("n"), "gene", F.concat(F.concat_ws("\t", "gene", F.transform("m", after_zeros)), rest).alias("value"))
    head = cells.agg(F.array_sort(F.collect_list("cell_id")).alias("cells"))
    head = head.select(F.lit(0).alias("n"), F.lit("").alias("gene"), F.concat_ws("\t", F.array(F.lit("")), F.transform("cells", lambda c: c.cast("string"))).alias("value"))
    path = writers.shared_path(spark, "dense")
    head.unionByName(body).orderBy("n", "gene").select("value").write.text(path)  # parts in order, the header in the first
    return readers.read_dense_matrix(spark, path, cnt.select(F.col("cell_id").cast("string").alias("cell")).distinct())


@query("a13_stamp_meta", "SELECT 'b' || n_regionkey AS dataset_id, 'new' AS dataset_name, n_name AS orig_dataset_name FROM nation")
def a13(spark, d):
    rows = table(spark, d, "nation").select(F.concat(F.lit("b"), "n_regionkey").alias("dataset_id"), F.col("n_name").alias("dataset_name"), F.lit("").alias("orig_dataset_name"))
    return controls.stamp_meta(rows, {"dataset_name": "new"})


@query("a15_read_regions", sql("ref_cnt ref_cells", "SELECT CAST(cell_id AS VARCHAR) AS cell, gene, count FROM ref_cnt JOIN ref_cells USING (cell_id) WHERE cell_type IN ('BUILDING', 'MACHINERY') AND cell_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"))
def a15(spark, d):
    """Files for each segment, two of which are read; one that matches is no Parquet file. Tasks write their own parts,
    which are then named by segment and number."""
    chosen = ref_cells(spark, d).where(F.col("cell_type").isin("AUTOMOBILE", "BUILDING", "MACHINERY"))
    rows = ref_counts(spark, d).join(chosen, "cell_id").select(F.col("cell_id").cast("string").alias("cell"), "gene", "count", "cell_type")
    base = writers.shared_path(spark, "regions")
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.partitionBy("cell_type").parquet(f"{base}/tmp")
    files.mkdirs(hadoop.Path(f"{base}/in"))
    for found in files.globStatus(hadoop.Path(f"{base}/tmp/cell_type=*/part-*")):
        segment, part = found.getPath().getParent().getName().removeprefix("cell_type="), found.getPath().getName()
        files.rename(found.getPath(), hadoop.Path(f"{base}/in/{segment}-{part}"))
    broken = files.create(hadoop.Path(f"{base}/in/BUILDING-broken.parquet"))
    broken.write(bytearray(b"no table"))
    broken.close()
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("cell")).distinct()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return readers.read_regions(spark, f"{base}/in", "{BUILDING,MACHINERY}-*", urgent)


@query("f10_numbered_ids", "SELECT o_orderkey, o_custkey AS id FROM orders")
def f10(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("CR-a"), F.col("o_custkey") % 3, F.lit("-"), "o_custkey").alias("id"))
    return tables.numbered_ids(rows, "id")


@query("a4_global_cell_id", "SELECT o_orderkey, CASE WHEN o_custkey % 50 > 0 THEN (o_orderkey % 9) * ((SELECT max(o_custkey % 50) FROM orders) + 1) + o_custkey % 50 ELSE 0 END AS cell_id FROM orders")
def a4(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9).alias("fov"), (F.col("o_custkey") % 50).alias("cell_ID"))
    return readers.global_cell_id(rows).select("o_orderkey", "cell_id")


@query("a6_pick_boundary", """SELECT o_custkey AS cell_id, o_orderkey AS seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 != 3, o_orderkey % 5, o_orderkey) AS n FROM orders WHERE o_orderkey % 4 != 0) WHERE n = 1""")
def a6(spark, d):
    k = F.col("o_orderkey")
    corner = F.array(F.struct(k.cast("double").alias("x"), k.cast("double").alias("y")))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("cell_id"), (k % 5).alias("z"), k.alias("seq"), F.when(k % 4 != 0, corner).alias("ring"))
    return readers.pick_boundary(rows).select("cell_id", "seq")


@query("m0_assemble", sql("pts cnt stats", "SELECT cell_id, n_counts, n_genes, n_counts >= (SELECT least(310.0, quantile_cont(n_counts, 0.2)) FROM stats) AS passed_QC FROM stats"))
def m0(spark, d):
    pts = points(spark, d)
    cnt = agg.count_matrix(pts)
    cells = agg.cell_stats(cnt)
    return assembly.assemble(pts, cells, cnt, agg.qc_filter(cells, 310))["cells"]
