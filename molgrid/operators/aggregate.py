"""Counting molecules: matrices, cell and gene statistics, quality flags. All are sums that merge before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molgrid.operators.sample import with_row_id


def count_matrix(pts: DataFrame) -> DataFrame:
    """cell_id, gene, count of the assigned molecules."""
    return pts.where("cell_id > 0").groupBy("cell_id", F.col("feature_name").alias("gene")).agg(F.count("*").alias("count"))


def cell_centroids(pts: DataFrame) -> DataFrame:
    return pts.where("cell_id > 0").groupBy("cell_id").agg(F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"))


def cell_stats(cnt: DataFrame) -> DataFrame:
    return cnt.groupBy("cell_id").agg(F.sum("count").alias("n_counts"), F.count_if(F.col("count") > 0).alias("n_genes"))


def gene_stats(cnt: DataFrame) -> DataFrame:
    return cnt.groupBy("gene").agg(F.sum("count").alias("n_counts"), F.count_if(F.col("count") > 0).alias("n_cells"))


def pct_noise(pts: DataFrame) -> DataFrame:
    return pts.agg(F.avg((F.col("cell_id") <= 0).cast("double")).alias("pct_noise"))


def to_wide(cnt: DataFrame, genes: list[str]) -> DataFrame:
    """One column for each of the given genes."""
    return cnt.where(F.col("gene").isin(genes)).groupBy("cell_id").pivot("gene", genes).agg(F.sum("count")).na.fill(0)


def explode_counts(cnt: DataFrame) -> DataFrame:
    """One row for each counted molecule, with a running transcript_id from 0 and placeholder coordinates."""
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("nth")
    rows = cnt.where("count > 0").select("cell_id", F.col("gene").alias("feature_name"), one)
    rows = with_row_id(rows, "cell_id", "feature_name", "nth", name="transcript_id")
    return rows.withColumns({"x": F.col("cell_id").cast("double"), "y": F.col("cell_id").cast("double"), "z": F.lit(0.0), "qv": F.lit(0.0)})


def assigned_cells(pts: DataFrame) -> DataFrame:
    return pts.where("cell_id != 0").select("cell_id").distinct()


def qc_filter(cells: DataFrame, min_counts: int = 10, min_cell_percentage: float = 0.8) -> DataFrame:
    """passed_QC: enough counts, with the cut lowered so that the given share of the cells passes."""
    cut = cells.agg(F.least(F.lit(float(min_counts)), F.percentile("n_counts", F.lit(1 - min_cell_percentage))).alias("__cut"))
    return cells.crossJoin(F.broadcast(cut)).withColumn("passed_QC", F.col("n_counts") >= F.col("__cut")).drop("__cut")


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy("n", key)


def majority_label(df: DataFrame) -> DataFrame:
    """Most frequent label of each cell and its share; ties go to the smaller label."""
    n = df.groupBy("cell_id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("cell_id").agg(
        F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), (F.max("n") / F.sum("n")).alias("share")
    )


def dedupe_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def argmax_label(scores: DataFrame, by: str = "cell_id") -> DataFrame:
    """Label of the highest score; ties go to the smaller label."""
    return scores.groupBy(by).agg(F.min_by("label", F.struct(-F.col("score"), "label")).alias("label"), F.max("score").alias("score"))
