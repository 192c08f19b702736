"""What several training-data operators share: reading, materialising, text keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Where that is not set, a local session gets a temporary folder; on a cluster it is an error, since no executor
    would see the driver's own disk.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    The lineage is cut there: a lost executor costs a re-read, never a recomputation of what came before. The shuffle
    files that led to it are of no more use, so Spark is told to drop them when the write is over.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/molgrid-{name}-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before) if before is not None else spark.conf.unset(clean)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote, once nothing will read them again."""
    for table_ in tables:
        spark = table_.sparkSession
        for folder in {f.rpartition("/")[0] for f in table_.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """Stands beside doc_id, so that rows that repeat an id with another text stay apart."""
    return F.xxhash64(text)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], column: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `at_once` bytes of the string or binary column; a larger row is one slice."""
    for b in batches:
        size = np.cumsum(np.array(pc.fill_null(pc.binary_length(b.column(column)), 0), dtype=np.int64))
        first = 0
        while first < b.num_rows:
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + at_once, side="right")))
            yield b.slice(first, last - first)
            first = last


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 200_000) -> Iterator[pa.Table]:
    """Cut a partition sorted by `keys` into tables of at least `at_least` rows that hold whole groups."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        merged = pa.Table.from_batches(held).combine_chunks()
        last = {k: merged.column(k)[rows - 1] for k in keys}
        cut = rows
        step = 1
        # walk back over the last group, in growing steps, then forward to its first row
        while cut and all(merged.column(k)[max(0, cut - step)] == last[k] for k in keys):
            cut = max(0, cut - step)
            step *= 2
        low, high = max(0, cut - step), cut
        while low < high:
            mid = (low + high) // 2
            if all(merged.column(k)[mid] == last[k] for k in keys):
                high = mid
            else:
                low = mid + 1
        cut = low
        if cut:
            yield merged.slice(0, cut)
        rest = merged.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
