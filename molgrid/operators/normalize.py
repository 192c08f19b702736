"""Normalisation and correction of long count tables (cell_id, gene, count and layers); zeros are absent rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molgrid.functions.scalars import uniform
from molgrid.operators.annotate import type_profiles
from molgrid.operators.arrays import sum_arrays
from molgrid.operators.neighbours import matrix


def _median(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.percentile(col, F.lit(0.5)).alias("__target"))


def _scaled(cnt: DataFrame, size: DataFrame, target: float | None) -> DataFrame:
    """log1p(count * target / size); the target is the median size unless given. size: cell_id, __size."""
    goal = _median(size, "__size") if target is None else size.sparkSession.range(1).select(F.lit(float(target)).alias("__target"))
    sized = size.crossJoin(F.broadcast(goal))
    joined = cnt.join(sized, "cell_id")
    return joined.withColumn("normalized", F.log1p(F.col("count") * F.col("__target") / F.col("__size"))).drop("__size", "__target")


def normalize_by_counts(cnt: DataFrame, target_sum: float | None = None) -> DataFrame:
    totals = cnt.groupBy("cell_id").agg(F.sum("count").cast("double").alias("__size")).where("__size > 0")
    return _scaled(cnt, totals, target_sum)


def normalize_by_volume(cnt: DataFrame, volumes: DataFrame, target: float | None = None) -> DataFrame:
    """Volumes are those of the cells counted; null or non-positive ones are an error once it runs."""
    ok = F.when(F.col("volume") > 0, F.col("volume")).otherwise(F.raise_error(F.lit("volumes must be above 0")).cast("double"))
    return _scaled(cnt, volumes.select("cell_id", ok.alias("__size")), target)


def log_cp(cnt: DataFrame, target: float = 10_000) -> DataFrame:
    return normalize_by_counts(cnt, target)


def renormalize(cnt: DataFrame, corrected: str = "corrected") -> DataFrame:
    """Corrected counts with the size factor that the old layers imply."""
    factor = cnt.groupBy("cell_id").agg((F.sum("count") / F.sum(F.expm1("normalized"))).alias("__f"))
    return cnt.join(factor, "cell_id").withColumn("renormalized", F.log1p(F.col(corrected) / F.col("__f"))).drop("__f")


def log_norm_counts(cnt: DataFrame, value: str = "count") -> DataFrame:
    """log2(x / factor + 1) with library factors of mean 1."""
    size = cnt.groupBy("cell_id").agg(F.sum(value).cast("double").alias("__size")).where("__size > 0")
    mean = size.agg(F.avg("__size").alias("__mean"))
    joined = cnt.join(size.crossJoin(F.broadcast(mean)), "cell_id")
    return joined.withColumn("log_norm", F.log2(F.col(value) / (F.col("__size") / F.col("__mean")) + 1)).drop("__size", "__mean")


def no_correction(cnt: DataFrame) -> DataFrame:
    return cnt if "normalized_uncorrected" in cnt.columns else cnt.withColumn("normalized_uncorrected", F.col("normalized"))


def purify_counts(cnt: DataFrame, pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Takes the share of a cell's second type out of its counts.

    pairs: cell_id, first_type, second_type, first_weight, second_weight. Cells without a second type, and pairs
    without any expected count, stay as they are.
    """
    whole = profile.groupBy("cell_type").agg(F.sum("mean").alias("__s"))
    share = profile.join(whole, "cell_type").select("cell_type", "gene", (F.col("mean") / F.col("__s")).alias("p"))
    of = [share.select(F.col("cell_type").alias(f"{n}_type"), "gene", F.col("p").alias(f"p_{n}")) for n in ("first", "second")]
    rows = cnt.join(pairs, "cell_id", "left").join(of[0], ["first_type", "gene"], "left").join(of[1], ["second_type", "gene"], "left")
    own = F.col("first_weight") * F.coalesce("p_first", F.lit(0.0))
    other = F.col("second_weight") * F.coalesce("p_second", F.lit(0.0))
    purified = F.when(F.col("second_type").isNull() | (own + other == 0), F.col("count").cast("double")).otherwise(
        F.try_divide(F.col("count") * own, own + other)
    )
    return rows.select(*cnt.columns, purified.alias("purified"))


def gene_efficiencies(cnt: DataFrame, cells: DataFrame, ref_cnt: DataFrame, ref_cells: DataFrame, layer: str = "normalized") -> DataFrame:
    """gene, efficiency: summed type means of the spatial side over those of the reference, on shared types."""
    sides = [type_profiles(a, b, layer).select("cell_type", "gene", F.col("mean").alias(n)) for a, b, n in ((cnt, cells, "sp"), (ref_cnt, ref_cells, "sc"))]
    types = cells.select("cell_type").intersect(ref_cells.select("cell_type"))
    both = sides[0].join(sides[1], ["cell_type", "gene"], "full").join(types, "cell_type", "left_semi")
    return both.groupBy("gene").agg(F.try_divide(F.sum("sp"), F.sum("sc")).alias("efficiency"))


def gene_efficiency(cnt: DataFrame, cells: DataFrame, ref_cnt: DataFrame, ref_cells: DataFrame, layer: str = "normalized") -> DataFrame:
    """The layer divided by its gene's efficiency; genes without one, or with 0, stay."""
    eff = gene_efficiencies(cnt, cells, ref_cnt, ref_cells, layer)
    joined = cnt.join(eff, "gene", "left")
    return joined.withColumn("corrected", F.when(F.col("efficiency") > 0, F.try_divide(F.col(layer), F.col("efficiency"))).otherwise(F.col(layer))).drop("efficiency")


def spline_basis(z: Column, degree: int, pieces: int) -> list[Column]:
    """B-splines of the degree over `pieces` equal parts of [0, 1], by their recursion; outside, the ends count."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)) * pieces
    # knots -degree, ..., pieces + degree; only the parts within [0, 1] have points, the last one its end as well
    part = F.least(F.floor(at), F.lit(pieces - 1))
    level = [(part == k).cast("double") for k in range(-degree, pieces + degree)]
    for d in range(1, degree + 1):
        level = [((at - k) * level[i] + (k + d + 1 - at) * level[i + 1]) / d for i, k in enumerate(range(-degree, pieces + degree - d))]
    return level


def normalize_spatial(
    cnt: DataFrame, cells: DataFrame, degree: int = 3, pieces: int = 2, sample_p: float = 0.25, ridge: float = 1e-3, seed: int = 777, large: int = 100_000, sample_cells: int = 25_000
) -> DataFrame:
    """Spatially aware: log counts regressed, for each gene, on a smooth surface of the position and on log library size
    times another one, of which the latter is taken out.

    Surfaces are tensor products of B-splines of the degree in x and in y, with a ridge. The fit is on a share sample_p of the
    cells, or sample_cells / n of more than `large` ones, by hash. The design's products are summed once over the sample, in
    tasks; those with a gene over its non-zero counts. All that is solved, on the driver, has twice (pieces + degree) squared
    rows. cells: cell_id, x, y.
    """
    lib = cnt.groupBy("cell_id").agg(F.ln(F.sum("count").cast("double")).alias("lib"))
    placed = cells.select("cell_id", "x", "y").join(lib, "cell_id")
    s = placed.agg(F.count("*").alias("n"), F.avg("lib").alias("lib"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]).first()
    share = sample_cells / s["n"] if s["n"] > large else sample_p
    z = {c: (F.col(c) - F.lit(s[f"min_{c}"])) / F.lit(((s[f"max_{c}"] or 0.0) - (s[f"min_{c}"] or 0.0)) or 1.0) for c in ("x", "y")}
    width = pieces + degree
    axes = placed.select("cell_id", (F.col("lib") - F.lit(s["lib"])).alias("lib"), F.array(*spline_basis(z["x"], degree, pieces)).alias("bx"), F.array(*spline_basis(z["y"], degree, pieces)).alias("by"))
    basis = axes.select("cell_id", "lib", F.flatten(F.transform("bx", lambda u: F.transform("by", lambda v: u * v))).alias("b"))
    half = width**2
    chosen = basis.where(uniform(seed, F.col("cell_id")) < share).select("cell_id", F.concat("b", F.transform("b", lambda v: v * F.col("lib"))).alias("b"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * half, 2 * half))
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * half), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    found = sum_arrays(chosen.select("b").mapInArrow(products, "i int, v array<double>"), ["i"], "v").toPandas()
    gram = np.zeros((2 * half, 2 * half))
    for i, v in zip(found["i"], found["v"]):
        gram[i] = v
    inverse = np.linalg.pinv(gram + ridge * max(np.trace(gram) / (2 * half), 1e-12) * np.eye(2 * half))[half:]

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}  # of a panel's genes
        for b in batches:
            genes, place = np.unique(np.array(b.column("gene").to_pylist(), dtype=object), return_inverse=True)
            y = np.zeros((len(genes), 2 * half))
            np.add.at(y, place, b.column("y").to_numpy()[:, None] * matrix(b.column("b")))
            for g, v in zip(genes, y):
                total[g] = total[g] + v if g in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["gene", "r"])

    def beta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(matrix(b.column(1)) @ inverse.T), pa.list_(pa.float64()))], names=["gene", "beta"])

    logged = F.log1p(F.col("count").cast("double"))
    sides = sum_arrays(cnt.join(chosen, "cell_id").select("gene", logged.alias("y"), "b").mapInArrow(right, "gene string, r array<double>"), ["gene"], "r")
    rows = cnt.join(basis, "cell_id").join(sides.mapInArrow(beta, "gene string, beta array<double>"), "gene", "left")
    effect = F.coalesce(F.aggregate(F.zip_with("b", "beta", lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v), F.lit(0.0))
    return rows.select(*cnt.columns, F.greatest(F.lit(0.0), logged - F.col("lib") * effect).alias("normalized"))
