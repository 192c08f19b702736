"""Cell types from the density of molecules, without cell outlines first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molgrid.operators.aggregate import majority_label


def annotate_density(pts: DataFrame, profile: DataFrame, bandwidth: float = 4.0, um_per_px: float = 1.0, step: float = 4.0, min_cor: float = 0.2, min_expr: float = 0.1) -> DataFrame:
    """cell_id, label, share: Gaussian density of each gene on a grid, correlated with the types' profiles; molecules
    take their grid point's label, cells the majority of theirs.

    Molecules are counted on the grid before they are spread over the neighbourhood (cut at three bandwidths), so
    crowded places cost no more rows. Grid points under either threshold have no label.
    """
    genes = profile.select("gene").distinct()
    at = pts.select(
        "transcript_id", "cell_id", F.col("feature_name").alias("gene"),
        F.round(F.col("x") * um_per_px / step).cast("long").alias("gx"), F.round(F.col("y") * um_per_px / step).cast("long").alias("gy"),
    ).join(F.broadcast(genes), "gene", "left_semi")
    reach = int(3 * bandwidth / step)
    kernel = [(i, j, 2.718281828459045 ** (-((i * step) ** 2 + (j * step) ** 2) / (2 * bandwidth**2))) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in kernel])).alias("o")
    on_grid = at.groupBy("gx", "gy", "gene").agg(F.count("*").alias("n"))
    points = at.select("gx", "gy").distinct()
    spread = on_grid.select("gene", "n", "gx", "gy", offsets).groupBy((F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"), "gene").agg(F.sum(F.col("n") * F.col("o.w")).alias("d"))
    density = spread.join(points, ["gx", "gy"], "left_semi")
    n = genes.agg(F.count("*").alias("n_genes"))
    own = density.groupBy("gx", "gy").agg(F.sum("d").alias("sx"), F.sum(F.col("d") ** 2).alias("sxx"))
    ref = profile.groupBy("cell_type").agg(F.sum("mean").alias("sy"), F.sum(F.col("mean") ** 2).alias("syy"))
    both = density.join(F.broadcast(profile.select("cell_type", "gene", "mean")), "gene").groupBy("gx", "gy", "cell_type").agg(F.sum(F.col("d") * F.col("mean")).alias("sxy"))
    rows = both.join(own, ["gx", "gy"]).join(F.broadcast(ref), "cell_type").crossJoin(F.broadcast(n))
    top = F.col("n_genes") * F.col("sxy") - F.col("sx") * F.col("sy")
    low = F.sqrt((F.col("n_genes") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n_genes") * F.col("syy") - F.col("sy") ** 2))
    scored = rows.withColumn("r", F.round(F.try_divide(top, low), 9)).where((F.col("r") >= min_cor) & (F.col("sx") >= min_expr))
    label = scored.groupBy("gx", "gy").agg(F.min_by("cell_type", F.struct(-F.col("r"), "cell_type")).alias("label"))
    return majority_label(at.where("cell_id > 0").join(label, ["gx", "gy"]).select("cell_id", "label"))
