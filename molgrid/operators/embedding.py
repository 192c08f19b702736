"""Principal components, and how two modalities mix in an embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molgrid.operators.arrays import sum_arrays
from molgrid.operators.neighbours import knn, matrix

#: Values of a batch that are worked on at once.
AT_ONCE = 4_000_000


def _chunks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A few rows at a time, with their vectors as a matrix."""
    for whole in batches:
        if not whole.num_rows:
            continue
        wide = len(whole.column(column)[0])
        step = max(1, AT_ONCE // max(wide, 1))
        for s in range(0, whole.num_rows, step):
            b = whole.slice(s, step)
            yield b, matrix(b.column(column))


def _by_covariance(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and loadings from the matrix of products, which the driver gets: features squared."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _chunks(batches):
            own = np.vstack([x.T @ x, x.sum(axis=0), np.full(x.shape[1], len(x))])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    total = matrix(sum_arrays(df.mapInArrow(products, "i int, v array<double>"), ["i"], "v").orderBy("i").select("v").toArrow().column(0))
    d = total.shape[1]
    n = total[d + 1, 0]
    mean = total[d] / n
    values, vectors = np.linalg.eigh((total[:d] - n * np.outer(mean, mean)) / max(n - 1, 1))
    return mean, vectors[:, np.argsort(values)[::-1][:k]]


def _tall_qr(rows: DataFrame, width: int, spread: int = 16) -> np.ndarray:
    """The triangular factor (up to signs of its rows) of a matrix with few columns: in tasks, again in `spread` tasks, then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for _, x in _chunks(batches):
            r = np.linalg.qr(np.vstack([r, x]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["v"])

    once = rows.mapInArrow(run, "v array<double>").repartition(spread).mapInArrow(run, "v array<double>")
    return np.linalg.qr(matrix(once.toArrow().column(0)), mode="r")


def _by_power_iteration(df: DataFrame, vector: str, k: int, d: int, spare: int, most: int, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and loadings by randomised block power iteration: what tasks add up and the driver holds is features times k + spare.

    Rounds end when none of the first k variances moves by more than the tolerance; the last step takes them from a
    tall-skinny QR of the projected rows, which doesn't square their condition.
    """
    n, total = 0, np.zeros(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(d + 1)
        for _, x in _chunks(batches):
            own += np.append(x.sum(axis=0), len(x))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([own], pa.list_(pa.float64()))], names=["i", "v"])

    *total, n = sum_arrays(df.mapInArrow(sums, "i int, v array<double>"), ["i"], "v").first()["v"]
    mean = np.array(total) / n
    width = min(k + spare, d, int(n))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    before = np.zeros(width)
    for _ in range(most):

        def product(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            own, shift = np.zeros((d, width)), mean @ q
            for _, x in _chunks(batches):
                y = x @ q - shift
                own += x.T @ y - np.outer(mean, y.sum(axis=0))
            step = 4096
            for s in range(0, d, step):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, min(s + step, d)), pa.int32()), pa.array(list(own[s : s + step]), pa.list_(pa.float64()))], names=["i", "v"])

        z = np.zeros((d, width))
        for row in sum_arrays(df.mapInArrow(product, "i int, v array<double>"), ["i"], "v").toLocalIterator():
            z[row["i"]] = row["v"]
        ritz = np.sort(np.linalg.eigvalsh((q.T @ z + z.T @ q) / 2))[::-1]
        q = np.linalg.qr(z)[0]
        if np.all(np.abs(ritz[:k] - before[:k]) <= tolerance * ritz[0]):
            break
        before = ritz
    shift = mean @ q

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(x @ q - shift), pa.list_(pa.float64()))], names=["v"])

    _, _, vt = np.linalg.svd(_tall_qr(df.mapInArrow(projected, "v array<double>"), width), full_matrices=False)
    return mean, q @ vt[:k].T


def pca(
    df: DataFrame, id_col: str, vector: str, k: int, *, exact_dims: int = 2048, spare: int = 16, most: int = 60, tolerance: float = 1e-7, seed: int = 1
) -> tuple[DataFrame, np.ndarray]:
    """(id, X_pca) and the loadings.

    Up to exact_dims features tasks add up their products and the driver takes the eigenvectors; beyond, nothing of the
    size of features squared is made (randomised block power iteration). Signs are fixed: the largest loading of each
    component is positive.
    """
    vectors = df.select(F.col(vector).cast("array<double>").alias("v"))
    first = vectors.first()
    if first is None:
        return df.select(id_col, F.array().cast("array<double>").alias("X_pca")), np.zeros((0, 0))
    d = len(first["v"])
    mean, load = _by_covariance(vectors, vector, k) if d <= exact_dims else _by_power_iteration(vectors, vector, k, d, spare, most, tolerance, seed)
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list((x - mean) @ load), pa.list_(pa.float64()))], names=[id_col, "X_pca"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, F.col(vector).cast("array<double>").alias("v")).mapInArrow(project, f"{id_col} {kind}, X_pca array<double>"), load


def knn_mixing(a: DataFrame, b: DataFrame, k: int, components: int, blocks: int | None = None) -> DataFrame:
    """Score in [0, 1]: for each shared type (id, vector, cell_type), the share of neighbours of the other modality
    over the expected one, at most 1, averaged over types."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    both = both.withColumn("key", F.col("id") * 2 + F.col("side"))
    types = a.select("cell_type").intersect(b.select("cell_type"))
    both = both.join(types, "cell_type", "left_semi")
    placed, _ = pca(both, "key", "vector", components)
    edges = knn(placed, "key", "X_pca", k, blocks)
    info = both.select("key", "side", "cell_type")
    joined = edges.join(info.withColumnsRenamed({"key": "src", "side": "s", "cell_type": "t"}), "src").join(
        info.withColumnsRenamed({"key": "dst", "side": "os", "cell_type": "ot"}), "dst"
    ).where("t = ot")
    share = joined.groupBy("t", "s").agg(F.avg((F.col("s") != F.col("os")).cast("double")).alias("observed"))
    sizes = info.groupBy(F.col("cell_type").alias("t")).agg(*[F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1)])
    expected = F.when(F.col("s") == 0, F.col("n1")).otherwise(F.col("n0")) / (F.col("n0") + F.col("n1") - 1)
    scored = share.join(F.broadcast(sizes), "t").select("t", F.least(F.lit(1.0), F.col("observed") / expected).alias("v"))
    by_type = scored.groupBy("t").agg(F.avg("v").alias("v"))
    return by_type.agg(F.avg("v").alias("metric_value")).select(F.lit("knn_mixing").alias("metric_id"), "metric_value")
