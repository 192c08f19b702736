"""Control datasets, and the preparation of a dataset pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molgrid.operators.aggregate import cell_stats, explode_counts
from molgrid.operators.geometry import Box, crop_points, crop_shapes, crop_window, tissue_center
from molgrid.operators.sample import balanced_subsample, permute_column
from molgrid.operators.spatial import rasterize
from molgrid.operators.tables import make_unique


def control_identity(cnt: DataFrame, cells: DataFrame) -> dict[str, DataFrame]:
    """The reference as if it were spatial: unit volumes, centroids 0, everything passed."""
    own = cells.join(cell_stats(cnt), "cell_id", "left").na.fill(0, ["n_counts", "n_genes"])
    own = own.withColumns({"volume": F.lit(1.0), "centroid_x": F.lit(0.0), "centroid_y": F.lit(0.0), "passed_QC": F.lit(True)})
    return {"counts": cnt, "cells": own, "transcripts": explode_counts(cnt)}


def control_permuted(cnt: DataFrame, cells: DataFrame, seed: int) -> dict[str, DataFrame]:
    """The same with cell types dealt anew."""
    return control_identity(cnt, permute_column(cells, "cell_type", "cell_id", seed))


#: Metadata keys that are refreshed when a dataset is derived from another.
META_KEYS = ("dataset_id", "dataset_name", "dataset_url", "dataset_reference", "dataset_summary", "dataset_description", "dataset_organism")


def stamp_meta(meta: DataFrame, params: dict[str, str]) -> DataFrame:
    """One row of metadata with the keys of `params` overwritten; an `orig_` column that is there keeps the old value."""
    cols = {}
    for k in META_KEYS:
        if f"orig_{k}" in meta.columns and k in meta.columns:
            cols[f"orig_{k}"] = F.col(k)
        if k in params:
            cols[k] = F.lit(params[k])
    return meta.withColumns(cols)


def process_dataset(
    pts: DataFrame, poly: DataFrame, ref_cnt: DataFrame, ref_cells: DataFrame, n_cells: int, box: Box | None, seed: int,
    image: tuple[int, int] | None = None, max_pixels: int | None = None, meta: DataFrame | None = None, params: dict[str, str] | None = None,
    ref_genes: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """A comparable pair: reference cells in balance, genes of both sides, molecules and outlines of the crop.

    Without a box, the crop is a window of at most `max_pixels` of the image (width, height) around the tissue's middle.
    With reference genes (gene_id, gene: a name that may repeat), counts come by gene_id, and repeated names get -1, -2, ...
    in the order of gene_id before genes are shared. With an image, the kept outlines are also drawn as label spans; with metadata, they are stamped with `params`.
    """
    unit = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    if box is None:
        if image is None or max_pixels is None:
            raise ValueError("a crop needs a box, or an image and its largest number of pixels")
        w = crop_window(tissue_center(pts, unit, *image), *image, max_pixels).first()
        box = (w.x, w.y, w.x + w.w, w.y + w.h)
    chosen = balanced_subsample(ref_cells, "cell_type", "cell_id", n_cells, seed)
    if ref_genes is not None:
        ref_cnt = ref_cnt.join(make_unique(ref_genes.select("gene_id", "gene"), "gene", "gene_id"), "gene_id").drop("gene_id")
    genes = pts.select(F.col("feature_name").alias("gene")).intersect(ref_cnt.select("gene"))
    cnt = ref_cnt.join(chosen.select("cell_id"), "cell_id", "left_semi").join(genes, "gene", "left_semi")
    cropped = crop_points(pts, unit, box).join(genes.withColumnRenamed("gene", "feature_name"), "feature_name", "left_semi")
    out = {"transcripts": cropped, "polygons": crop_shapes(poly, unit, box), "ref_counts": cnt, "ref_cells": chosen}
    if image is not None:
        out["labels"] = rasterize(out["polygons"], *image)
    if meta is not None:
        out["metadata"] = stamp_meta(meta, params or {})
    return out
