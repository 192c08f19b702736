"""Sinks: any table as CSV or Parquet, and molecules and outlines in the Xenium layout."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Overwrites what is there."""
    out = df.write.mode("overwrite").partitionBy(*partition_by)
    out.option("header", True).csv(path) if fmt == "csv" else out.format(fmt).save(path)


def xenium_transcripts(pts: DataFrame) -> DataFrame:
    """The layout's columns; cell 0 is spelled UNASSIGNED."""
    cell = F.when(F.col("cell_id") == 0, F.lit("UNASSIGNED")).otherwise(F.col("cell_id").cast("string"))
    return pts.select(
        "transcript_id", F.col("x").alias("x_location"), F.col("y").alias("y_location"),
        (F.col("z") if "z" in pts.columns else F.lit(0.0)).cast("float").alias("z_location"), "feature_name", cell.alias("cell_id"),
        F.lit(40.0).cast("float").alias("qv"), (F.col("cell_id") > 0).cast("tinyint").alias("overlaps_nucleus"),
    )


def xenium_boundaries(poly: DataFrame) -> DataFrame:
    """One row for each corner, in order."""
    return poly.select(F.col("cell_id").cast("string"), F.posexplode("ring").alias("vertex", "p")).select("cell_id", "vertex", F.col("p.x").alias("vertex_x"), F.col("p.y").alias("vertex_y"))


def export_xenium(pts: DataFrame, poly: DataFrame, path: str) -> None:
    write_table(xenium_transcripts(pts), f"{path}/transcripts.parquet")
    write_table(xenium_boundaries(poly), f"{path}/cell_boundaries.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir).

    Where that setting is missing, a local session gets a temporary folder; on a cluster it is an error, since no
    executor would see the driver's own disk.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/molgrid-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read again: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` wrote, once nothing will read them again."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
