"""Reference profiles and cell-type annotation. Absent zeros count: means divide by group sizes, sums carry n."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molgrid.operators.aggregate import argmax_label


def type_profiles(cnt: DataFrame, cells: DataFrame, layer: str = "count") -> DataFrame:
    """cell_type, gene, mean of the layer and rate of detection, over all cells of the type."""
    sizes = cells.groupBy("cell_type").agg(F.count("*").alias("n_cells"))
    sums = cnt.join(cells.select("cell_id", "cell_type"), "cell_id").groupBy("cell_type", "gene").agg(
        F.sum(layer).alias("s"), F.count_if(F.col("count") > 0).alias("d")
    )
    return sums.join(F.broadcast(sizes), "cell_type").select(
        "cell_type", "gene", (F.col("s") / F.col("n_cells")).alias("mean"), (F.col("d") / F.col("n_cells")).alias("rate"), "n_cells"
    )


def hvg(cnt: DataFrame, cells: DataFrame, n_top: int, bins: int = 20, layer: str = "normalized") -> DataFrame:
    """gene, hvg_score, hvg: dispersion against the median of its mean's bin, in units of the bin's deviation."""
    n = cells.agg(F.count("*").alias("n"))
    sums = cnt.groupBy("gene").agg(F.sum(layer).alias("s"), F.sum(F.col(layer) ** 2).alias("q")).crossJoin(F.broadcast(n))
    mean = F.col("s") / F.col("n")
    variance = (F.col("q") - F.col("n") * mean**2) / (F.col("n") - 1)
    stats = sums.select("gene", mean.alias("mean"), F.when(mean > 0, variance / mean).otherwise(F.lit(0.0)).alias("dispersion"))
    binned = stats.withColumn("bin", F.ntile(bins).over(Window.orderBy("mean", "gene")))  # one row for each gene
    middle = binned.groupBy("bin").agg(F.percentile("dispersion", F.lit(0.5)).alias("median"))
    off = binned.join(F.broadcast(middle), "bin").withColumn("off", F.abs(F.col("dispersion") - F.col("median")))
    mad = off.groupBy("bin").agg(F.percentile("off", F.lit(0.5)).alias("mad"))
    score = F.when(F.col("mad") > 0, F.try_divide(F.col("dispersion") - F.col("median"), F.col("mad"))).otherwise(F.lit(0.0))
    scored = off.join(F.broadcast(mad), "bin").select("gene", score.alias("hvg_score"))
    rank = F.row_number().over(Window.orderBy(F.desc("hvg_score"), "gene"))
    return scored.withColumn("hvg", rank <= n_top)


def de_genes(profile: DataFrame, gene_cutoff: float, fc_cutoff: float) -> DataFrame:
    """cell_type, gene whose mean exceeds the cutoff, and that of every other type by the log fold change."""
    types = profile.select("cell_type").distinct().agg(F.count("*").alias("types"))
    best = profile.groupBy("gene").agg(
        F.max_by("cell_type", F.struct("mean", "cell_type")).alias("top"),
        F.sort_array(F.collect_list("mean"), False).alias("m"),  # a value for each type
        F.count("*").alias("k"),
    )
    second = F.when(F.size("m") > 1, F.get("m", F.lit(1))).otherwise(F.lit(0.0))
    rows = best.crossJoin(F.broadcast(types)).withColumn("rest", F.when(F.col("types") > 1, second).otherwise(F.lit(0.0)))
    first = F.get("m", F.lit(0))
    change = F.ln(first + 1e-9) - F.ln(F.col("rest") + 1e-9)
    return rows.where((first > gene_cutoff) & (change >= fc_cutoff)).select(F.col("top").alias("cell_type"), "gene", first.alias("mean"), change.alias("log_fc"))


def _common(cnt: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides on their shared genes, and the number of these."""
    genes = cnt.select("gene").intersect(profile.select("gene"))
    return cnt.join(genes, "gene", "left_semi"), profile.join(genes, "gene", "left_semi"), genes.agg(F.count("*").alias("n"))


def correlation_scores(cnt: DataFrame, profile: DataFrame) -> DataFrame:
    """cell_id, label, score: Pearson of log2 CPM with each type's profile (gene, cell_type, mean) on the shared
    genes, from sums, so that absent zeros cost nothing."""
    cnt, profile, n = _common(cnt, profile)
    total = cnt.groupBy("cell_id").agg(F.sum("count").alias("total"))
    x = cnt.join(total, "cell_id").select("cell_id", "gene", F.log2(1 + F.col("count") * 1e6 / F.col("total")).alias("x"))
    sums = profile.groupBy("cell_type").agg(F.sum("mean").alias("__t"))
    y = profile.join(sums, "cell_type").select("cell_type", "gene", F.log2(1 + F.try_divide(F.col("mean") * 1e6, F.col("__t"))).alias("y"))
    own = x.groupBy("cell_id").agg(F.sum("x").alias("sx"), F.sum(F.col("x") ** 2).alias("sxx"))
    ref = y.groupBy("cell_type").agg(F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy"))
    both = x.join(y, "gene").groupBy("cell_id", "cell_type").agg(F.sum(F.col("x") * F.col("y")).alias("sxy"))
    rows = both.join(own, "cell_id").join(F.broadcast(ref), "cell_type").crossJoin(F.broadcast(n))
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    low = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2))
    return rows.select("cell_id", F.col("cell_type").alias("label"), F.coalesce(F.try_divide(top, low), F.lit(0.0)).alias("score"))


def annotate_correlation(cnt: DataFrame, profile: DataFrame) -> DataFrame:
    """cell_id, label, score of the most similar type; ties go to the smaller name. Scores are compared to 9 digits."""
    return argmax_label(correlation_scores(cnt, profile).withColumn("score", F.round("score", 9)))
