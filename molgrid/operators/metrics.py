"""Scores of a processed dataset: without and with a reference. Every score is one row: metric_id, metric_value."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molgrid.functions.scalars import UNANNOTATED
from molgrid.operators.arrays import sum_arrays
from molgrid.sources.writers import written


def _score(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(value.cast("double").alias("metric_value")).select(F.lit(name).alias("metric_id"), "metric_value")


def assigned_reads(pts: DataFrame) -> DataFrame:
    """Share of molecules with a cell."""
    return _score(pts, "proportion_of_assigned_reads", F.avg((F.col("cell_id") > 0).cast("double")))


def assigned_reads_by_gene(pts: DataFrame) -> DataFrame:
    """gene, proportion: 0 for genes without an assigned molecule."""
    return pts.groupBy(F.col("feature_name").alias("gene")).agg(F.avg((F.col("cell_id") > 0).cast("double")).alias("proportion"))


def annotated_cells(cells: DataFrame) -> DataFrame:
    known = F.col("cell_type").isNotNull() & (F.col("cell_type") != UNANNOTATED)
    return _score(cells, "proportion_of_annotated_cells", F.avg(known.cast("double")))


def n_cells(cells: DataFrame) -> DataFrame:
    return _score(cells, "number_of_cells", F.count("*"))


Side = tuple[DataFrame, DataFrame]  # counts with a normalized layer, cells with a cell_type


def shared(sp: Side, sc: Side) -> tuple[Side, Side]:
    """Both sides on their shared genes and types."""
    genes = sp[0].select("gene").intersect(sc[0].select("gene"))
    types = sp[1].select("cell_type").intersect(sc[1].select("cell_type"))

    def cut(side: Side) -> Side:
        cells = side[1].join(types, "cell_type", "left_semi")
        return side[0].join(genes, "gene", "left_semi").join(cells.select("cell_id"), "cell_id", "left_semi"), cells

    return cut(sp), cut(sc)


class Sums(NamedTuple):
    """A side as types and genes: sums of its layers and cells that detect the gene, and the cells of each type.

    Cells without a type are one, so that all genes of the counts are there. Both tables are written; scores read them only.
    """

    table: DataFrame
    sizes: DataFrame


def sums_of(side: Side) -> Sums:
    """One pass over the counts of a side, whatever scores follow."""
    cnt, cells = side
    layers = [F.sum(c).cast("double").alias(c) for c in ("count", "normalized") if c in cnt.columns]
    table = cnt.join(cells.select("cell_id", "cell_type"), "cell_id", "left").groupBy("cell_type", "gene").agg(*layers, F.count_if(F.col("count") > 0).alias("detected"))
    return Sums(written(table, "type-sums"), written(cells.groupBy("cell_type").agg(F.count("*").alias("n")), "type-sizes"))


def _shared_profiles(sp: Sums, sc: Sums, layer: str) -> list[DataFrame]:
    """cell_type, gene, mean, rate, n of both sides on shared types and genes: tables of types times genes."""
    genes = sp.table.select("gene").intersect(sc.table.select("gene"))
    types = sp.sizes.select("cell_type").intersect(sc.sizes.select("cell_type"))
    out = []
    for side in (sp, sc):
        sized = side.table.join(F.broadcast(side.sizes.join(types, "cell_type", "left_semi")), "cell_type").join(genes, "gene", "left_semi")
        out.append(sized.select("cell_type", "gene", (F.col(layer) / F.col("n")).alias("mean"), (F.col("detected") / F.col("n")).alias("rate"), "n"))
    return out


def _negative_pairs(profile: DataFrame, max_rate: float, min_cells: int) -> DataFrame:
    """gene, cell_type that the reference hardly ever detects, types of enough cells only."""
    types = profile.where(F.col("n") >= min_cells).select("cell_type").distinct()
    every = types.crossJoin(profile.select("gene").distinct())  # types times genes of a panel
    rates = profile.select("cell_type", "gene", "rate")
    return every.join(rates, ["cell_type", "gene"], "left").where(F.coalesce("rate", F.lit(0.0)) < max_rate).select("cell_type", "gene")


def _marker_purity(sp: Sums, sc: Sums, name: str, kind: str, max_rate: float, min_cells: int) -> DataFrame:
    profiles = _shared_profiles(sp, sc, "count")
    pairs = _negative_pairs(profiles[1], max_rate, min_cells)
    means = []
    for profile in profiles:
        if kind == "reads":
            whole = profile.groupBy("gene").agg(F.sum("mean").alias("whole"))
            values = profile.join(whole, "gene").select("cell_type", "gene", (F.col("mean") / F.col("whole")).alias("v"))
        else:
            values = profile.select("cell_type", "gene", F.col("rate").alias("v"))
        means.append(pairs.join(values, ["cell_type", "gene"], "left").agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("m")))
    both = means[0].select(F.col("m").alias("a")).crossJoin(F.broadcast(means[1].select(F.col("m").alias("b"))))
    return both.select(F.lit(name).alias("metric_id"), (1 - F.greatest(F.lit(0.0), F.col("a") - F.col("b"))).alias("metric_value"))


def neg_marker_purity_reads(sp: Side, sc: Side, max_rate: float = 0.005, min_cells: int = 10) -> DataFrame:
    return _marker_purity(sums_of(sp), sums_of(sc), "neg_marker_purity_reads", "reads", max_rate, min_cells)


def neg_marker_purity_cells(sp: Side, sc: Side, max_rate: float = 0.005, min_cells: int = 10) -> DataFrame:
    return _marker_purity(sums_of(sp), sums_of(sc), "neg_marker_purity_cells", "cells", max_rate, min_cells)


#: Genes of a block: a task holds one matrix of so many squared.
BLOCK_GENES = 512


def _panel(genes: DataFrame) -> DataFrame:
    """gene, i: genes in order. A panel's genes, or a transcriptome's, are few."""
    return genes.agg(F.sort_array(F.collect_set("gene")).alias("genes")).select(F.posexplode("genes").alias("i", "gene"))


def _cell_rows(side: Side, by_type: bool, panel: DataFrame) -> DataFrame:
    """kind, cell_id, v: the normalized values that are not 0, with their places in the panel, in order."""
    cnt, cells = side
    kind = F.col("cell_type") if by_type else F.lit("all")
    values = cnt.where("normalized != 0").join(F.broadcast(panel), "gene").join(cells.select("cell_id", kind.alias("kind")), "cell_id")
    return values.groupBy("kind", "cell_id").agg(F.sort_array(F.collect_list(F.struct("i", F.col("normalized").cast("double").alias("x")))).alias("v"))


def _products(block: int):
    """Rows (kind, bi, bj, a, b), sorted by the first three -> rows of the sum of outer products of a and b: kind, bi, bj, g, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def rows() -> pa.RecordBatch:
            g = np.flatnonzero(total.any(axis=1))
            kind, bi, bj = key
            n = len(g)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array([bi] * n, pa.int32()), pa.array([bj] * n, pa.int32()), pa.array(g + bi * block, pa.int32()), pa.array(list(total[g]), pa.list_(pa.float64()))], names=["kind", "bi", "bj", "g", "v"])

        for b in batches:
            sides = []
            for c in ("a", "b"):
                flat = b.column(c).flatten()
                sides.append((b.column(c).offsets.to_numpy() - b.column(c).offsets[0].as_py(), flat.field("i").to_numpy() % block, flat.field("x").to_numpy()))
            for k, own in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "bi", "bj")))):
                if own != key:
                    if key is not None:
                        yield rows()
                    key, total = own, np.zeros((block, block))
                (at, x), (to, y) = ((i[o[k] : o[k + 1]], v[o[k] : o[k + 1]]) for o, i, v in sides)
                total[np.ix_(at, to)] += np.outer(x, y)
        if key is not None:
            yield rows()

    return run


GRAM = "kind string, bi int, bj int, g int, v array<double>"


def gram(side: Side, by_type: bool, panel: DataFrame, n_genes: int, block: int = BLOCK_GENES, salts: int = 16) -> DataFrame:
    """kind, bi, bj, g, v: row g of the matrix of gene-gene products, cut to block bj of its columns; bj <= bi.

    Panels of one block are added up where the cells are. Larger ones go by pairs of blocks (and a salt, so that a kind
    of most cells is shared out): a cell's row travels cut into its blocks. Either way a task holds one block squared
    at a time, and matrix rows, not pairs of genes, are what is shuffled and added up.
    """
    rows = _cell_rows(side, by_type, panel)
    if n_genes <= block:
        zero = F.lit(0)
        cut = rows.select("kind", zero.alias("bi"), zero.alias("bj"), F.col("v").alias("a"), F.col("v").alias("b")).sortWithinPartitions("kind")
    else:
        present = F.array_distinct(F.transform("v", lambda x: F.floor(x["i"] / block).cast("int")))
        pairs = F.flatten(F.transform("present", lambda i: F.transform(F.filter("present", lambda j: j <= i), lambda j: F.struct(i.alias("bi"), j.alias("bj")))))
        cut = rows.withColumn("present", present).select("kind", F.pmod(F.xxhash64("cell_id"), F.lit(salts)).alias("salt"), "v", F.explode(pairs).alias("p"))
        cut = cut.select("kind", "salt", "p.bi", "p.bj", "v")

        def of(column: str) -> Column:
            return F.filter("v", lambda x: F.floor(x["i"] / block) == F.col(column))

        cut = cut.select("kind", "salt", "bi", "bj", of("bi").alias("a"), of("bj").alias("b"))
        cut = cut.repartition("kind", "bi", "bj", "salt").drop("salt").sortWithinPartitions("kind", "bi", "bj")
    parts = cut.mapInArrow(_products(block), GRAM)
    return sum_arrays(parts, ["kind", "bi", "bj", "g"], "v", ["kind", "bi", "bj"])


def _moments(side: Side, by_type: bool, panel: DataFrame, n_genes: int) -> DataFrame:
    """kind, n, s, var: cells, and by place in the panel the sums and the variances (times n squared) of the values."""
    cnt, cells = side
    kind = F.col("cell_type") if by_type else F.lit("all")
    n = cells.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    values = cnt.join(cells.select("cell_id", kind.alias("kind")), "cell_id").groupBy("kind", "gene").agg(F.sum("normalized").alias("s"), F.sum(F.col("normalized") ** 2).alias("q"))
    every = n.crossJoin(F.broadcast(panel)).join(values, ["kind", "gene"], "left")  # kinds times genes
    s, q = (F.coalesce(c, F.lit(0.0)) for c in ("s", "q"))
    rows = every.select("kind", "n", F.struct("i", s.alias("s"), (F.col("n") * q - s**2).alias("var")).alias("m"))
    return rows.groupBy("kind", "n").agg(F.sort_array(F.collect_list("m")).alias("m")).select("kind", "n", F.col("m.s").alias("s"), F.col("m.var").alias("var"))


def _row_correlations(b: pa.RecordBatch, k: int, side: str, before: int) -> np.ndarray:
    """Of row k: Pearson of its gene with the first `before` genes of its block; not a number where a gene is constant."""
    n, own_s, own_var = (b.column(c + side)[k].as_py() for c in ("n", "gs", "gvar"))
    s, var = (b.column(c + side)[k].values.to_numpy()[:before] for c in ("s", "var"))
    v = b.column("v" + side)[k]
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (n * (v.values.to_numpy()[:before] if v.is_valid else 0.0) - own_s * s) / np.sqrt(own_var * var)
    r[(var <= 1e-9) | (own_var <= 1e-9)] = np.nan
    return r


def _correlated(sides: list[Side], by_type: bool, panel: DataFrame, n_genes: int, block: int) -> DataFrame:
    """One row for each matrix row of each kind that all sides have: kind, g, bj and for each side v, n, the gene's
    moments gs, gvar, and those of the block, s, var."""
    places = panel.select(F.col("i").alias("g"), F.explode(F.sequence(F.lit(0), F.floor(F.col("i") / block).cast("int"))).alias("bj"))
    out = None
    for k, side in enumerate(sides):
        moments = _moments(side, by_type, panel, n_genes)
        own = moments.select("kind").crossJoin(F.broadcast(places)) if out is None else out
        products = gram(side, by_type, panel, n_genes, block).select("kind", "g", "bj", F.col("v").alias(f"v{k}"))
        of_kind = F.broadcast(moments.select("kind", F.col("n").alias(f"n{k}"), "s", "var"))
        met = own.join(products, ["kind", "g", "bj"], "left").join(of_kind, "kind")
        cut = {f"{c}{k}": F.slice(c, F.col("bj") * block + 1, F.lit(block)) for c in ("s", "var")}
        out = met.withColumns({f"gs{k}": F.get("s", F.col("g")), f"gvar{k}": F.get("var", F.col("g")), **cut}).drop("s", "var")
    return out


def gene_correlations(side: Side, by_type: bool, block: int = BLOCK_GENES) -> DataFrame:
    """kind, g, h (g < h), r: Pearson of the normalized layer over cells, zeros included; constant genes are left out."""
    panel = _panel(side[0])
    n_genes = panel.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (kind, g, bj) in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "g", "bj")))):
                r = _row_correlations(b, k, "0", min(block, g - bj * block))
                at = np.flatnonzero(~np.isnan(r))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at + bj * block, pa.int32()), pa.array([g] * len(at), pa.int32()), pa.array(r[at])], names=["kind", "i", "j", "r"])

    pairs = _correlated([side], by_type, panel, n_genes, block).mapInArrow(run, "kind string, i int, j int, r double")
    named = [F.broadcast(panel.select(F.col("i").alias(c), F.col("gene").alias(n))) for c, n in (("i", "g"), ("j", "h"))]
    return pairs.join(named[0], "i").join(named[1], "j").select("kind", "g", "h", "r")


def _kept(side: Side, name: str) -> Side:
    """A side written once: what reads it several times does not count the molecules again."""
    return written(side[0].select("cell_id", "gene", "normalized"), f"{name}-counts"), written(side[1].select("cell_id", "cell_type"), f"{name}-cells")


def coexpression_similarity(sp: Side, sc: Side, by_type: bool = False, block: int = BLOCK_GENES) -> DataFrame:
    """Correlations of both sides meet by matrix rows; only their differences are added up."""
    return _coexpression(_kept(sp, "sp"), _kept(sc, "sc"), by_type, block)


def _coexpression(sp: Side, sc: Side, by_type: bool = False, block: int = BLOCK_GENES) -> DataFrame:
    """The same for sides that are written."""
    sp, sc = shared(sp, sc)
    panel = _panel(sp[0])
    n_genes = panel.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, total, pairs = b.column("kind").to_pylist(), [], []
            for k, (g, bj) in enumerate(zip(b.column("g").to_pylist(), b.column("bj").to_pylist())):
                before = min(block, g - bj * block)
                apart = np.abs(_row_correlations(b, k, "0", before) - _row_correlations(b, k, "1", before))
                total.append(float(np.nansum(apart)))
                pairs.append(int((~np.isnan(apart)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(total), pa.array(pairs, pa.int64())], names=["kind", "apart", "pairs"])

    found = _correlated([sp, sc], by_type, panel, n_genes, block).mapInArrow(run, "kind string, apart double, pairs long")
    by_kind = found.groupBy("kind").agg(F.sum("apart").alias("apart"), F.sum("pairs").alias("pairs")).where("pairs > 0").select("kind", (1 - F.col("apart") / F.col("pairs") / 2).alias("v"))
    return _score(by_kind, "coexpression_similarity" + "_celltype" * by_type, F.avg("v"))


def _relative_pairs(sp: Sums, sc: Sums, name: str, across: str, along: str) -> DataFrame:
    """Differences of means over pairs of `across`, for each `along`, scaled by their absolute sum on each side.

    A difference needs both members: a profile has few types and a panel of genes, so pairs are of bounded number."""
    profiles = _shared_profiles(sp, sc, "normalized")
    full = profiles[0].select("cell_type").distinct().crossJoin(profiles[0].select("gene").distinct())
    sides = []
    for profile, v in zip(profiles, "ab"):
        p = full.join(profile, ["cell_type", "gene"], "left").select(along, across, F.coalesce("mean", F.lit(0.0)).alias(v))
        left, right = p, p.select(along, F.col(across).alias("other"), F.col(v).alias("w"))
        d = left.join(right, along).where(F.col(across) < F.col("other")).select(along, across, "other", (F.col(v) - F.col("w")).alias(v))
        total = d.groupBy(along).agg(F.sum(F.abs(v)).alias("t"))
        sides.append(d.join(total, along).select(along, across, "other", F.coalesce(F.try_divide(F.col(v), F.col("t")), F.lit(0.0)).alias(v)))
    both = sides[0].join(sides[1], [along, across, "other"]).groupBy(along).agg((1 - F.sum(F.abs(F.col("a") - F.col("b"))) / 2).alias("v"))
    return _score(both, name, F.avg("v"))


def relative_celltype_similarity(sp: Side, sc: Side) -> DataFrame:
    """Over pairs of types, for each gene."""
    return _relative_pairs(sums_of(sp), sums_of(sc), "rel_pairwise_ct_expr_sim", "cell_type", "gene")


def relative_gene_similarity(sp: Side, sc: Side) -> DataFrame:
    """Over pairs of genes, for each type."""
    return _relative_pairs(sums_of(sp), sums_of(sc), "rel_pairwise_gene_expr_sim", "gene", "cell_type")


def all_metrics(sp: Side, sc: Side, max_rate: float = 0.005) -> DataFrame:
    """Every similarity score for all cells, and for those that passed quality control (`_qc_filtered`).

    Sides are written once, and summed up by types and genes once for each set of cells; a score is one row, written by a
    job of its own, so no plan holds twelve scores.
    """
    columns = ("cell_id", "gene", "count", "normalized"), ("cell_id", "cell_type")
    sp = written(sp[0].select(*columns[0]), "sp-counts"), written(sp[1].select(*columns[1], "passed_QC"), "sp-cells")
    sc = written(sc[0].select(*columns[0]), "sc-counts"), written(sc[1].select(*columns[1]), "sc-cells")
    passed = sp[1].where("passed_QC")
    kept = (sp[0].join(passed.select("cell_id"), "cell_id", "left_semi"), passed)
    reference, rows = sums_of(sc), []
    for cells, suffix in ((sp, ""), (kept, "_qc_filtered")):
        sums = sums_of(cells), reference
        scores = {
            "reads": _marker_purity(*sums, "neg_marker_purity_reads", "reads", max_rate, 10), "cells": _marker_purity(*sums, "neg_marker_purity_cells", "cells", max_rate, 10),
            "coexpression": _coexpression(cells, sc), "coexpression_by_type": _coexpression(cells, sc, True),
            "types": _relative_pairs(*sums, "rel_pairwise_ct_expr_sim", "cell_type", "gene"), "genes": _relative_pairs(*sums, "rel_pairwise_gene_expr_sim", "gene", "cell_type"),
        }
        for name, score in scores.items():
            rows.append(written(score.withColumn("metric_id", F.concat("metric_id", F.lit(suffix))), f"score-{name}"))
    return reduce(lambda a, b: a.unionByName(b), rows)


def collect_scores(runs: DataFrame) -> DataFrame:
    """One row for each score of runs (run_id, dataset_id, metric_ids, metric_values)."""
    zipped = F.explode(F.arrays_zip("metric_ids", "metric_values")).alias("m")
    return runs.select("run_id", "dataset_id", zipped).select("run_id", "dataset_id", F.col("m.metric_ids").alias("metric_id"), F.col("m.metric_values").alias("metric_value"))
