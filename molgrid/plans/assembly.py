"""The processed dataset, and which operator serves which stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from molgrid.operators import aggregate, annotate, assignment, controls, density, mapping, metrics, normalize, shapes, spatial
from molgrid.operators.tables import assert_cells, attach

#: Columns that an assembled cell table may have.
CELL_COLUMNS = ("cell_id", "region", "centroid_x", "centroid_y", "centroid_z", "n_counts", "n_genes", "volume", "cell_type", "passed_QC")
POINT_COLUMNS = ("transcript_id", "x", "y", "z", "feature_name", "cell_id", "qv")


def _allowed(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def assemble(pts: DataFrame, cells: DataFrame, cnt: DataFrame, qc: DataFrame) -> dict[str, DataFrame]:
    """transcripts, cells (quality flags joined), counts, outlines; `checked` has the numbers of ids and cells and is
    an error once it runs if there are fewer ids than cells."""
    return {
        "transcripts": _allowed(pts, POINT_COLUMNS),
        "cells": _allowed(attach(cells, qc.select("cell_id", "passed_QC")), CELL_COLUMNS),
        "counts": cnt,
        "polygons": shapes.cell_hulls(pts),
        "checked": assert_cells(pts, cells),
    }


#: Stage -> name -> operator. Users add their own.
STAGES: dict[str, dict[str, Callable[..., object]]] = {
    "segmentation": {"custom": spatial.use_labels, "binning": spatial.assign_by_bins},
    "assignment": {"labels": spatial.assign_by_labels, "polygons": spatial.assign_by_polygons, "probabilistic": assignment.probabilistic_assign, "trimmed": assignment.trim_assignment},
    "count_aggregation": {"basic": aggregate.count_matrix},
    "qc_filter": {"basic": aggregate.qc_filter},
    "cell_volume": {"alpha_shapes": shapes.cell_volumes},
    "normalization": {"by_counts": normalize.normalize_by_counts, "by_volume": normalize.normalize_by_volume, "spatial": normalize.normalize_spatial},
    "annotation": {"correlation": annotate.annotate_correlation, "spearman": mapping.annotate_spearman, "transport": mapping.annotate_ot, "weights": mapping.annotate_weights, "decomposition": mapping.decompose, "density": density.annotate_density},
    "expression_correction": {"none": normalize.no_correction, "purified": normalize.purify_counts, "renormalized": normalize.renormalize},
    "gene_efficiency": {"none": normalize.no_correction, "efficiency": normalize.gene_efficiency},
    "metric": {"assigned_reads": metrics.assigned_reads, "annotated_cells": metrics.annotated_cells, "n_cells": metrics.n_cells, "similarity": metrics.all_metrics},
    "control": {"identity": controls.control_identity, "permuted": controls.control_permuted},
}
