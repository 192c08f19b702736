"""Molecules that fit their cell's type, or do not: scores, trimming, and probabilistic assignment."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molgrid.functions.scalars import UNANNOTATED
from molgrid.operators.spatial import near_lists, nearest
from molgrid.sources.writers import discard, written


def _log_rates(profile: DataFrame, pseudo: float = 1e-5) -> DataFrame:
    """cell_type, gene, ln p: every gene for every type of the panel, with a pseudo-count."""
    every = profile.select("cell_type").distinct().crossJoin(profile.select("gene").distinct())
    whole = profile.groupBy("cell_type").agg(F.sum("mean").alias("s"))
    p = every.join(profile.select("cell_type", "gene", "mean"), ["cell_type", "gene"], "left").join(whole, "cell_type")
    return p.select("cell_type", "gene", F.ln(F.coalesce(F.col("mean"), F.lit(0.0)) / F.col("s") + pseudo).alias("ln_p"))


def score_transcripts(pts: DataFrame, cells: DataFrame, profile: DataFrame, cutoff: float = -2.0) -> DataFrame:
    """Molecules of typed cells with score (ln p under the cell's type less the best type's) and flagged (<= cutoff)."""
    rates = _log_rates(profile)
    best = rates.groupBy("gene").agg(F.max("ln_p").alias("top"))
    table = rates.join(best, "gene").select("cell_type", F.col("gene").alias("feature_name"), (F.col("ln_p") - F.col("top")).alias("score"))
    typed = pts.join(cells.select("cell_id", "cell_type"), "cell_id")
    return typed.join(F.broadcast(table), ["cell_type", "feature_name"]).withColumn("flagged", F.col("score") <= cutoff)


def trim_assignment(scored: DataFrame, min_molecules: int) -> DataFrame:
    """Flagged molecules go to cell 0, and so do all of cells that are left with too few."""
    moved = scored.withColumn("cell_id", F.when(F.col("flagged"), F.lit(0)).otherwise(F.col("cell_id")).cast("long"))
    large = moved.where("cell_id > 0").groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_molecules).select("cell_id", F.lit(True).alias("__ok"))
    return moved.join(large, "cell_id", "left").withColumn("cell_id", F.when(F.col("__ok"), F.col("cell_id")).otherwise(F.lit(0)).cast("long")).drop("__ok")


#: Types times genes that a task may hold as a matrix.
LARGEST_PROFILE = 20_000_000
#: Cells times genes times types that are worked out at once.
AT_ONCE = 2_000_000


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, for x > 0: six steps up, then its asymptotic series."""
    up = sum(1 / (x + k) for k in range(6))
    y = 1 / (x + 6) ** 2
    return np.log(x + 6) - 0.5 / (x + 6) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - up


@dataclass
class Rates:
    """What all cells share in a round: genes times types of mean expression, efficiency by gene, and the fixed parameters."""

    mu: np.ndarray
    eta: np.ndarray
    r_spot: float
    spot_reg: float
    prior: np.ndarray  # of the types, the empty one last

    def types(self, n: np.ndarray, area: np.ndarray) -> np.ndarray:
        """cells x (types and the empty one): posterior from the counts of all genes, zeros among them (negative binomial)."""
        m, r = self._due(area) + self.spot_reg, self.r_spot
        known = np.einsum("cg,cgt->ct", n, np.log(m / (m + r))) - r * np.log1p(m / r).sum(axis=1)
        empty = n.sum(axis=1) * np.log(self.spot_reg / (self.spot_reg + r)) - r * len(self.mu) * np.log1p(self.spot_reg / r)
        l = np.column_stack([known, empty]) + np.log(self.prior)
        e = np.exp(l - l.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _due(self, area: np.ndarray) -> np.ndarray:
        return area[:, None, None] * (self.mu * self.eta[:, None])[None]

    def expected(self, n: np.ndarray, area: np.ndarray, p: np.ndarray) -> np.ndarray:
        """cells x genes: expected logarithm of the rate of a gene's molecules, over types and their gamma factors."""
        m0, r = self._due(area), self.r_spot
        empty = np.log(self.spot_reg) - np.log(r)
        return np.einsum("ct,cgt->cg", p[:, :-1], np.log(m0 + self.spot_reg) - np.log(r + m0)) + p[:, -1:] * empty + digamma(r + n)

    def sums(self, n: np.ndarray, area: np.ndarray, p: np.ndarray) -> np.ndarray:
        """For each gene: molecules that the types lead to expect (gamma factors at their means), and those of cells that are not empty."""
        gamma = (self.r_spot + n)[:, :, None] / (self.r_spot + self._due(area))
        due = np.einsum("ct,gt,c,cgt->g", p[:, :-1], self.mu, area, gamma)
        return np.concatenate([due, (n * (1 - p[:, -1:])).sum(axis=0)])


def _parts(batches: Iterator[pa.RecordBatch], rates: Rates) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """Rows (cell_id, area, p, genes, n) a few at a time: with areas, types, counts as a matrix, and the places of the counts in it."""
    step = max(1, AT_ONCE // rates.mu.size)
    for whole in batches:
        for s in range(0, whole.num_rows, step):
            b = whole.slice(s, step)
            place = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column("genes")))), b.column("genes").flatten().to_numpy()
            n = np.zeros((b.num_rows, len(rates.mu)))
            n[place] = b.column("n").flatten().to_numpy()
            yield b, b.column("area").to_numpy(), b.column("p").flatten().to_numpy().reshape(b.num_rows, -1), n, place


def _types(rates: Rates):
    """Cells with new type probabilities; and for each task a row without a cell that has its sums by gene."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * len(rates.mu))
        for b, area, old, n, _ in _parts(batches, rates):
            p = rates.types(n, area)
            total += rates.sums(n, area, p)
            moved = pa.array(np.abs(p - old).max(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("cell_id"), b.column("area"), pa.array(list(p), DOUBLES), b.column("genes"), b.column("n"), moved, pa.nulls(b.num_rows, DOUBLES)], names=STATE)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.int64(), pa.float64(), DOUBLES, pa.list_(pa.int32()), DOUBLES, pa.float64())] + [pa.array([total], DOUBLES)], names=STATE)

    return run


def _expected(rates: Rates):
    """cell_id, g, e: the expected logarithms of the genes that a cell may have molecules of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, area, p, n, (row, gene) in _parts(batches, rates):
            e = rates.expected(n, area, p)[row, gene]
            yield pa.RecordBatch.from_arrays([b.column("cell_id").take(pa.array(row)), pa.array(gene), pa.array(e)], names=["cell_id", "g", "e"])

    return run


DOUBLES = pa.list_(pa.float64())
STATE = ["cell_id", "area", "p", "genes", "n", "moved", "sums"]


def _candidates(pts: DataFrame, cells: DataFrame, panel: DataFrame, neighbours: int, radius: float, inside_bonus: float, shrink: float = 10.0) -> DataFrame:
    """transcript_id, g, and for each of its nearest cells c0, w0, c1, w1 ...: a row for every molecule, with the log density
    of its place under the cell's own Gaussian. Molecules without a near cell, or of no gene of the panel, have nulls.

    A cell's scale is the mean square distance of the molecules labelled with it, drawn to that of all near molecules
    with the weight of `shrink` molecules.
    """
    slots = range(neighbours)
    rows = pts.select("transcript_id", "x", "y", F.col("feature_name").alias("gene"), F.col("cell_id").alias("prior")).join(F.broadcast(panel), "gene", "left")
    lists = near_lists(cells.select(F.col("cell_id").cast("long").alias("id"), "x", "y"), radius)
    near = nearest(rows, lists, neighbours, radius)
    places = [(F.get("near", F.lit(k))["neighbour"], F.get("near", F.lit(k))["distance"]) for k in slots]
    cut = [F.when(F.col("g").isNotNull(), v).alias(f"{n}{k}") for k, place in enumerate(places) for n, v in zip("cd", place)]
    base = written(near.select("transcript_id", "g", "prior", *cut), "near")
    d2 = [F.col(f"d{k}") ** 2 for k in slots]
    known = sum(F.col(f"c{k}").isNotNull().cast("long") for k in slots)
    spread = base.agg(F.sum(sum(F.coalesce(v, F.lit(0.0)) for v in d2)).alias("d2"), F.sum(known).alias("n")).select(F.greatest(F.try_divide("d2", "n"), F.lit(1e-9)).alias("all"))
    own = base.select("prior", F.coalesce(*[F.when(F.col(f"c{k}") == F.col("prior"), v) for k, v in zip(slots, d2)]).alias("d2")).where("d2 IS NOT NULL")
    own = written(own.groupBy("prior").agg(F.sum("d2").alias("d2"), F.count("*").alias("n")), "spread")
    every = base.crossJoin(F.broadcast(spread))
    for k in slots:
        every = every.join(own.select(F.col("prior").alias(f"c{k}"), F.col("d2").alias(f"s{k}"), F.col("n").alias(f"n{k}")), f"c{k}", "left")
    weights = []
    for k in slots:
        s2 = (F.coalesce(f"s{k}", F.lit(0.0)) + shrink * F.col("all")) / (2 * (F.coalesce(f"n{k}", F.lit(0)) + shrink))
        gauss = -F.col(f"d{k}") ** 2 / (2 * s2) - F.ln(2 * math.pi * s2)
        weights += [F.col(f"c{k}"), (gauss + F.when(F.col("prior") == F.col(f"c{k}"), inside_bonus).otherwise(0.0)).alias(f"w{k}")]
    out = written(every.select("transcript_id", "g", *weights), "candidates")
    discard(base, own, lists)
    return out


def _shared_out(candidates: DataFrame, expected: DataFrame, neighbours: int, misread_density: float) -> DataFrame:
    """`candidates` with p0, p1 ...: the share of the molecule that each near cell has, by softmax with the background.

    Cells' expected logarithms are joined once for each place in a row, so Spark sends them to the molecules where they are
    few; the molecules are shuffled only where they are not."""
    met = candidates
    for k in range(neighbours):
        met = met.join(expected.select(F.col("cell_id").alias(f"c{k}"), "g", F.col("e").alias(f"e{k}")), [f"c{k}", "g"], "left")
    l = [F.col(f"w{k}") + F.col(f"e{k}") for k in range(neighbours)]
    least = F.lit(math.log(misread_density))
    top = F.greatest(*l, least)
    low = sum(F.coalesce(F.exp(v - F.col("top")), F.lit(0.0)) for v in l) + F.exp(least - F.col("top"))
    weighed = met.withColumn("top", top).withColumn("low", low)
    return weighed.select(*candidates.columns, *[(F.exp(v - F.col("top")) / F.col("low")).alias(f"p{k}") for k, v in enumerate(l)])


def probabilistic_assign(
    pts: DataFrame, cells: DataFrame, profile: DataFrame, *, neighbours: int = 3, radius: float = 60.0, max_iter: int = 1000, tolerance: float = 0.02,
    inside_bonus: float = 2.0, misread_density: float = 1e-5, r_gene: float = 20.0, inefficiency: float = 0.2, r_spot: float = 2.0, spot_reg: float = 0.1, empty_prior: float = 0.5,
) -> DataFrame:
    """transcript_id, cell_id (0: background), prob, cell_type, cell_type_prob: molecules to one of their nearest cells,
    jointly with cell types; a molecule has its cell's most probable type, none in the background.

    cells: cell_id, x, y and, if known, area; a cell's expression is scaled by its area over the mean one (1 where it has
    none). profile: mean counts by type; molecules of other genes are background. Each round shares molecules out among
    candidates by place, prior label and expected expression (softmax with the background); then every cell, gene and type has
    a gamma factor (shape r_spot) from the expected counts, cells have type probabilities from all genes (negative
    binomial; a type without expression, unannotated in the result, has empty_prior), and genes an efficiency: (r_gene +
    molecules outside of empty cells) / (r_gene / inefficiency + expected ones). spot_reg is added to what a type leads to
    expect. Rounds end when no type probability moves by more than the tolerance; a warning tells where max_iter rounds
    were not enough. A cell is one row, and a task works on a few of them as a matrix; candidates are shuffled.
    Tables of a round go when the next one is written.
    """
    wide = profile.groupBy("gene").pivot("cell_type").agg(F.first("mean")).orderBy("gene")
    types = [c for c in wide.columns if c != "gene"]
    if wide.count() * len(types) > LARGEST_PROFILE:
        raise ValueError(f"probabilistic_assign: the profile has more than {LARGEST_PROFILE} values")
    panel = wide.fillna(0.0).toPandas()
    spark, n_types = pts.sparkSession, len(types)
    genes = spark.createDataFrame([(g, k) for k, g in enumerate(panel["gene"])], "gene string, g int")
    rates = Rates(panel[types].to_numpy(float), np.full(len(panel), inefficiency), r_spot, spot_reg, np.append(np.full(n_types, (1 - empty_prior) / n_types), empty_prior))
    candidates = _candidates(pts, cells, genes, neighbours, radius, inside_bonus)
    size = F.col("area") if "area" in cells.columns else F.lit(None).cast("double")
    known = cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.when(size > 0, size.cast("double")).alias("size"))
    mean = F.broadcast(known.agg(F.avg("size").alias("mean")))
    at = known.crossJoin(mean).select("cell_id", F.coalesce(F.col("size") / F.col("mean"), F.lit(1.0)).alias("area"))
    schema = "cell_id long, area double, p array<double>, genes array<int>, n array<double>, moved double, sums array<double>"

    def with_counts(before: DataFrame, counts: DataFrame) -> DataFrame:
        by_cell = counts.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("c")).select("cell_id", F.col("c.g").alias("genes"), F.col("c.n").alias("n"))
        kinds = {"genes": "array<int>", "n": "array<double>"}
        return before.join(by_cell, "cell_id", "left").select("cell_id", "area", "p", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in kinds.items()))

    pairs = F.explode(F.array(*[F.struct(F.col(f"c{k}").alias("cell_id"), F.lit(0.0).alias("n")) for k in range(neighbours)])).alias("s")
    held = candidates.where("g IS NOT NULL").select("g", pairs).where("s.cell_id IS NOT NULL").select("s.cell_id", "g", "s.n").distinct()
    start = at.withColumn("p", F.array(*[F.lit(float(v)) for v in rates.prior]))
    state = written(with_counts(start, held), "cells")
    expected, moved = None, None
    for _ in range(max_iter):
        real = state.where("cell_id IS NOT NULL")
        new_expected = written(real.select("cell_id", "area", "p", "genes", "n").mapInArrow(_expected(rates), "cell_id long, g int, e double"), "expected")
        shares = F.explode(F.array(*[F.struct(F.col(f"c{k}").alias("cell_id"), F.col(f"p{k}").alias("share")) for k in range(neighbours)])).alias("s")
        counts = _shared_out(candidates, new_expected, neighbours, misread_density).select("g", shares).where("s.share IS NOT NULL")
        counts = counts.groupBy("s.cell_id", "g").agg(F.sum("s.share").alias("n"))
        new = written(with_counts(real.select("cell_id", "area", "p"), counts).mapInArrow(_types(rates), schema), "cells")
        discard(state, *([expected] if expected is not None else []))
        state, expected = new, new_expected
        # twice as many numbers as the panel has genes
        sums = state.where("cell_id IS NULL").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()
        due, molecules = np.split(sums, 2)
        rates.eta = (r_gene + molecules) / (r_gene / inefficiency + due)
        moved = state.agg(F.max("moved")).first()[0]
        if moved is None or moved < tolerance:
            break
    else:
        warnings.warn(f"probabilistic_assign: type probabilities still moved by {moved} after {max_iter} rounds (tolerance {tolerance})", stacklevel=2)
    names = F.array(*[F.lit(t) for t in [*types, UNANNOTATED]])
    likely = F.array_max("p")
    of_cell = state.where("cell_id IS NOT NULL").select("cell_id", F.element_at(names, F.array_position("p", likely).cast("int")).alias("cell_type"), likely.alias("cell_type_prob"))
    shared = _shared_out(candidates, expected, neighbours, misread_density)
    slots = [F.when(F.col(f"p{k}").isNotNull(), F.struct(F.col(f"p{k}").alias("share"), (-F.col(f"c{k}")).alias("c"))) for k in range(neighbours)]
    best = shared.select("transcript_id", F.greatest(*slots).alias("b") if neighbours > 1 else slots[0].alias("b"), sum(F.coalesce(f"p{k}", F.lit(0.0)) for k in range(neighbours)).alias("all"))
    s = F.col("b.share")
    kept = written(best.select("transcript_id", F.when(s >= 1 - F.col("all"), -F.col("b.c")).otherwise(F.lit(0)).cast("long").alias("cell_id"), F.coalesce(F.greatest(s, 1 - F.col("all")), F.lit(1.0)).alias("prob")), "shares")
    discard(expected)
    return kept.join(of_cell, "cell_id", "left").select("transcript_id", "cell_id", "prob", "cell_type", "cell_type_prob")
