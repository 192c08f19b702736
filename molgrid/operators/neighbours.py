"""Nearest neighbours in an embedding: exact by blocks, or by a forest of random projections beyond a row count.

Either way rows meet in blocks of bounded size, each pair of blocks gives its best k, and these are merged. Exactly, all
blocks meet all others. In the forest, each tree cuts space at medians of random projections; a row meets the rows of its
own leaf and of the leaves behind the cuts it lies closest to (multi-probe), and distances are exact again. Leaves that
hold more rows than a block are dealt out to several blocks; nothing is capped. The forest is fitted on a sample of
bounded size, and all rows are placed in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molgrid.sources.writers import written

#: Rows of one block; a task holds two blocks and the distances of 512 rows at a time.
BLOCK = 4096
LEAF = 32


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


@dataclass
class Forest:
    """Random projections around a centre, and the cut of each inner node of each tree."""

    centre: np.ndarray
    directions: np.ndarray  # dimensions x (trees * depth)
    cuts: np.ndarray  # trees x (2 ** depth - 1), in the order of levels

    @property
    def depth(self) -> int:
        return self.directions.shape[1] // len(self.cuts)

    @classmethod
    def fitted(cls, sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
        """Every cut is the median of the sample's rows that reach the node, or of its parent's where none does."""
        rng = np.random.default_rng(seed)
        centre = sample.mean(axis=0)
        directions = rng.normal(size=(sample.shape[1], trees * depth))
        directions /= np.linalg.norm(directions, axis=0)
        at = (sample - centre) @ directions
        cuts = np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                first, n = 2**level - 1, 2**level
                value = at[:, t * depth + level]
                order = np.lexsort((value, node))
                own = node[order] - first
                start, stop = np.searchsorted(own, np.arange(n)), np.searchsorted(own, np.arange(n), side="right")
                middle = value[order[np.minimum((start + stop) // 2, len(order) - 1)]]
                cuts[t, first : first + n] = np.where(stop > start, middle, 0.0)
                node = 2 * node + 1 + (value >= cuts[t, node])
        return cls(centre, directions, cuts)

    def leaves(self, x: np.ndarray, probes: int) -> np.ndarray:
        """rows x trees x (1 + probes): numbers of the own leaf, and of those behind the closest cuts."""
        depth, trees = self.depth, len(self.cuts)
        at = (x - self.centre) @ self.directions
        out = np.zeros((len(x), trees, 1 + min(probes, depth)), np.int64)
        for t in range(trees):
            node, margin = np.zeros(len(x), np.int64), np.zeros((len(x), depth))
            for level in range(depth):
                value = at[:, t * depth + level]
                margin[:, level] = np.abs(value - self.cuts[t, node])
                node = 2 * node + 1 + (value >= self.cuts[t, node])
            out[:, t, 0] = node
            closest = np.argsort(margin, axis=1, kind="stable")
            for p in range(out.shape[2] - 1):
                node = np.zeros(len(x), np.int64)
                for level in range(depth):
                    side = at[:, t * depth + level] >= self.cuts[t, node]
                    node = 2 * node + 1 + (side ^ (closest[:, p] == level))
                out[:, t, 1 + p] = node
            out[:, t] += t << LEAF
        return out


def _meet(k: int):
    """Two blocks' rows -> src, dst, distance: the k rows of the second nearest to each of the first, ties to the smaller id."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        src, dst, far = [], [], []
        if a.num_rows and b.num_rows:
            b = b.sort_by("id")
            x, y, own, other = matrix(a.column("v")), matrix(b.column("v")), a.column("id").to_numpy(), b.column("id").to_numpy()
            yy = (y**2).sum(axis=1)
            for s in range(0, len(x), 512):
                part = x[s : s + 512]
                d = np.sqrt(np.maximum((part**2).sum(axis=1)[:, None] + yy - 2 * part @ y.T, 0)).round(9)
                d[own[s : s + 512][:, None] == other] = np.inf
                if len(y) > 4 * k:  # rows beyond the kth distance need no order
                    bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    row, at = np.nonzero(d <= bound)
                else:
                    row, at = np.nonzero(np.isfinite(d))
                value = d[row, at]
                order = np.lexsort((at, value, row))
                row, at, value = row[order], at[order], value[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                keep = (nth < k) & np.isfinite(value)
                src.append(own[s + row[keep]])
                dst.append(other[at[keep]])
                far.append(value[keep])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"src": join(src, pa.int64()), "dst": join(dst, pa.int64()), "distance": join(far, pa.float64())})

    return run


def _nearest(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """src, dst, distance of the k best of all blocks that met. left, right: id, v, leaf, and the blocks lb and rb."""
    keys = ["leaf", "lb", "rb"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k), "src long, dst long, distance double")
    # a pair may meet in several trees, with a distance that differs in its last digits
    once = met.repartition("src").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("rank") <= k)


def _dealt(column: str, n) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(n) if isinstance(n, int) else n).cast("long")


def _all(n) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("long") - 1))


def _other(rows: DataFrame) -> DataFrame:
    """The same columns id and v, which Spark does not take for those of the other side."""
    return rows.withColumns({"id": F.col("id") + 0, "v": F.slice("v", 1, F.size("v"))})


def _exact(rows: DataFrame, k: int, blocks: int) -> DataFrame:
    one = F.lit(0).cast("long").alias("leaf")
    left = rows.select("id", "v", one, _dealt("id", blocks).alias("lb"), _all(blocks).alias("rb"))
    right = _other(rows).select("id", "v", one, _all(blocks).alias("lb"), _dealt("id", blocks).alias("rb"))
    return _nearest(left, right, k)


def _by_forest(rows: DataFrame, k: int, n: int, leaf_rows: int, trees: int, probes: int, sample_rows: int, seed: int) -> DataFrame:
    depth = int(np.clip(np.round(np.log2(max(n, 1) / leaf_rows)), 1, np.log2(sample_rows / 16)))
    part = min(1.0, sample_rows / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) <= int(part * (1 << 30))).select("v").toArrow()
    forest = Forest.fitted(matrix(sample.column("v")), trees, depth, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = forest.leaves(matrix(b.column(1)), probes)
            lists = [pa.array(list(v), pa.list_(pa.int64())) for v in (at[:, :, 0], at.reshape(len(at), -1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["id", "v", "own", "probed"])

    placed = written(rows.mapInArrow(place, f"id long, v {dict(rows.dtypes)['v']}, own array<long>, probed array<long>"), "forest-leaves")
    members, asked = (placed.select("id", "v", F.explode(c).alias("leaf")) for c in ("own", "probed"))
    held, due = (df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias(c)) for df, c in ((members, "n_rb"), (asked, "n_lb")))
    # no more rows than the trees have leaves, which the sample bounds
    sizes = F.broadcast(written(held.join(due, "leaf"), "forest-sizes"))
    left = asked.join(sizes, "leaf").select("id", "v", "leaf", _dealt("id", F.col("n_lb")).alias("lb"), _all(F.col("n_rb")).alias("rb"))
    right = _other(members.join(sizes, "leaf")).select("id", "v", "leaf", _all(F.col("n_lb")).alias("lb"), _dealt("id", F.col("n_rb")).alias("rb"))
    return _nearest(left, right, k)


def _approximate(rows: DataFrame, k: int, n: int, **forest) -> DataFrame:
    """Equal vectors are one row in the forest, which stands for all of them and carries their k + 1 smallest ids."""
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    reps = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids")
    reps = written(reps, "distinct-vectors")
    near = _by_forest(reps.select("id", "v"), k, n, **forest).select("src", "dst", "distance")
    own = reps.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"))
    every = near.unionByName(own).join(reps.select(F.col("id").alias("dst"), "ids"), "dst").select("src", "distance", F.explode("ids").alias("dst"))
    best = Window.partitionBy("src").orderBy("distance", "dst")
    lists = (
        every.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
        .groupBy("src").agg(F.sort_array(F.collect_list(F.struct("distance", "dst"))).alias("near"))
    )
    of_rep = reps.select(F.col("id").alias("src"), "v").join(lists, "src").select("v", "near")
    others = F.slice(F.filter("near", lambda c: c["dst"] != F.col("id")), 1, k)
    found = rows.join(of_rep, "v").select(F.col("id").alias("src"), F.posexplode(others).alias("nth", "c"))
    return found.select("src", F.col("c.dst").alias("dst"), F.col("c.distance").alias("distance"), (F.col("nth") + 1).alias("rank"))


def knn(
    df: DataFrame, id_col: str, vector: str, k: int, blocks: int | None = None, *, exact_rows: int = 120_000, leaf_rows: int = 2048, trees: int = 6, probes: int = 5,
    sample_rows: int = 1 << 17, seed: int = 1,
) -> DataFrame:
    """src, dst, distance, connectivity, rank of the k nearest others; ties go to the smaller id.

    Up to exact_rows rows the result is exact, from as many blocks as the rows need (or `blocks`). Beyond, it is the
    forest's: its recall grows with trees, probes and leaf_rows; sample_rows bounds what it is fitted on. Copies of a vector
    are always found. Rows without a vector are left out.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    n = rows.count()
    if blocks or n <= max(exact_rows, 1):
        best = _exact(rows, k, blocks or max(1, -(-n // BLOCK)))
    else:
        best = _approximate(rows, k, n, leaf_rows=leaf_rows, trees=trees, probes=probes, sample_rows=sample_rows, seed=seed)
    width = F.max("distance").over(Window.partitionBy("src"))
    return best.withColumn("connectivity", F.when(width > 0, F.exp(-F.try_divide(F.col("distance"), width))).otherwise(F.lit(1.0)))
