"""Vendor layouts as canonical tables. Schemas are given, not inferred; only needed columns are read."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molgrid.functions.scalars import cell_id_or_zero, leading_number, numbers, ring
from molgrid.operators.sample import with_row_id
from molgrid.sources.writers import written


def read_xenium_points(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id, x, y, z, feature_name, cell_id, qv, overlaps_nucleus; unsigned ids that do not fit are an error."""
    t = spark.read.parquet(path)
    cell = cell_id_or_zero(F.col("cell_id")) if dict(t.dtypes)["cell_id"] != "string" else F.when(
        F.upper("cell_id").isin("UNASSIGNED", ""), None
    ).otherwise(F.col("cell_id"))
    return t.select(
        F.col("transcript_id").cast("long"), F.col("x_location").cast("double").alias("x"), F.col("y_location").cast("double").alias("y"),
        F.col("z_location").cast("double").alias("z"), F.col("feature_name").cast("string"), cell.alias("cell_id"),
        F.col("qv").cast("float"), (F.col("overlaps_nucleus") > 0).alias("overlaps_nucleus"),
    )


def read_cosmx_points(spark: SparkSession, path: str) -> DataFrame:
    """fov, cell_id (global), feature_name, x, y, z from a transcript CSV."""
    t = spark.read.option("header", True).csv(path)
    rows = t.select(
        F.col("fov").cast("long"), F.col("cell_ID").cast("long").alias("local_id"), F.col("target").alias("feature_name"),
        F.col("x_global_px").cast("double").alias("x"), F.col("y_global_px").cast("double").alias("y"), F.col("z").cast("double"),
    )
    return global_cell_id(rows, rows, id_col="local_id").drop("local_id")


def global_cell_id(df: DataFrame, *frames: DataFrame, fov: str = "fov", id_col: str = "cell_ID", name: str = "cell_id") -> DataFrame:
    """One id over all fields of view: fov * (largest local id + 1) + local id, and 0 for none. The largest id is that
    of all `frames` together."""
    top = None
    for f in frames or (df,):
        one = f.agg(F.max(id_col).alias("__m"))
        top = one if top is None else top.unionByName(one)
    top = top.agg(F.coalesce(F.max("__m"), F.lit(0)).alias("__m"))
    own = F.coalesce(F.col(id_col), F.lit(0))
    joined = df.crossJoin(F.broadcast(top))  # a single row
    return joined.withColumn(name, F.when(own > 0, F.col(fov) * (F.col("__m") + 1) + own).otherwise(F.lit(0)).cast("long")).drop("__m")


def rebuild_cosmx(spark: SparkSession, calls: str | list[str], fovs: str, cell_stats: str | list[str], scale: float, height: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Molecules, cells and counts from files for each field of view, whose number is in the file name.

    Fields without a position are left out; cells without molecules have no count rows but n_counts 0.
    """
    of_file = leading_number(F.input_file_name(), r"(?i)fov_?")
    at = spark.read.csv(fovs).select(F.col("_c5").cast("long").alias("fov"), F.col("_c0").cast("double").alias("x_mm"), F.col("_c1").cast("double").alias("y_mm"))
    at = at.groupBy("fov").agg(F.min(F.struct("x_mm", "y_mm")).alias("p")).select("fov", "p.x_mm", "p.y_mm")
    raw = spark.read.option("header", True).csv(calls).withColumn("fov", of_file).join(F.broadcast(at), "fov")
    cells = spark.read.option("header", True).csv(cell_stats).withColumn("fov", of_file).join(F.broadcast(at), "fov")
    x, y = (F.col(c).cast("double") for c in ("x", "y"))
    tx = raw.select("fov", F.col("CellId").cast("long").alias("cell_ID"), F.col("target").alias("feature_name"), (F.col("x_mm") * scale + x).alias("x"), (F.col("y_mm") * scale + (height - 1 - y)).alias("y"), F.col("z").cast("double"))
    cx, cy = (F.col(c).cast("double") for c in ("CenterX", "CenterY"))
    meta = cells.select("fov", F.col("CellId").cast("long").alias("cell_ID"), (F.col("x_mm") * scale + cx).alias("centroid_x"), (F.col("y_mm") * scale + (height - 1 - cy)).alias("centroid_y"), F.col("Area").cast("double").alias("area"))
    ids = (tx.select("cell_ID"), meta.select("cell_ID"))
    tx, meta = (global_cell_id(df, *ids) for df in (tx, meta))
    expr = tx.where("cell_id > 0").groupBy("cell_id", F.col("feature_name").alias("gene")).agg(F.count("*").alias("count"))
    total = expr.groupBy("cell_id").agg(F.sum("count").alias("n_counts"))
    return tx, meta.join(total, "cell_id", "left").na.fill(0, ["n_counts"]), expr


def read_merscope(spark: SparkSession, transcripts: str, cell_by_gene: str, metadata: str) -> tuple[DataFrame, DataFrame]:
    """Molecules, and long counts of the cells that the metadata have."""
    pts = spark.read.option("header", True).csv(transcripts).select(
        F.col("gene").alias("feature_name"), F.col("transcript_id").alias("ensembl_id"), F.col("x").cast("double"), F.col("y").cast("double"), F.col("global_z").cast("double").alias("z")
    )
    wide = spark.read.option("header", True).csv(cell_by_gene)
    first, *genes = wide.columns
    long = wide.select(F.col(f"`{first}`").alias("cell_id"), *[F.col(f"`{g}`").cast("long").alias(g) for g in genes]).unpivot("cell_id", [f"`{g}`" for g in genes], "gene", "count").where("count > 0")
    cells = spark.read.option("header", True).csv(metadata)
    return pts, long.join(cells.select(F.col(f"`{cells.columns[0]}`").alias("cell_id")), "cell_id", "left_semi")


def pick_boundary(poly: DataFrame, prefer_z: int = 3) -> DataFrame:
    """One ring for each cell: that of the preferred plane, else the lowest; cells without one are left out."""
    w = Window.partitionBy("cell_id").orderBy(F.col("z") != prefer_z, "z", "seq")
    some = poly.where(F.col("ring").isNotNull() & (F.size("ring") > 0))
    return some.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def read_experiments(spark: SparkSession, path: str, exclude: tuple[str, ...] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Metadata of experiments without the excluded ones, and with ids corrected by `rename`."""
    t = spark.read.option("header", True).csv(path).where(~F.col("experiment_id").isin(*exclude, ""))
    return t.replace(rename, subset=["experiment_id"]) if rename else t


def read_abca_spots(spark: SparkSession, path: str, width: float, um_per_px: float) -> DataFrame:
    """Spots in pixels, the x axis flipped, coordinates truncated."""
    t = spark.read.option("header", True).csv(path)
    px = (F.lit(width) - F.col("global_x").cast("double") / um_per_px).cast("long")
    return t.select(px.cast("double").alias("x"), (F.col("global_y").cast("double") / um_per_px).cast("long").cast("double").alias("y"), F.col("global_z").cast("double").alias("z"), F.col("target_gene").alias("feature_name"))


def read_abca_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """cell_id and ring from comma lists of coordinates; cells without any are left out."""
    t = spark.read.option("header", True).csv(path)
    first = t.columns[0]
    return t.select(F.col(f"`{first}`").alias("cell_id"), ring(numbers(F.col("boundaryX_z0")), numbers(F.col("boundaryY_z0"))).alias("ring")).where("ring is not null and size(ring) > 0")


def _placed(t: DataFrame, name: str = "__at") -> DataFrame:
    """`t`, read from text files, with each row's place: file by name, start of the split, and row in it. Splits come to
    tasks by size, not in order, so the row's number alone is no order of the whole."""
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n"))
    return t.select("*", at.alias(name))


def _numbered(t: DataFrame) -> DataFrame:
    """Rows of text files with their numbers from 0, as `line`."""
    return with_row_id(_placed(t), "__at", name="line").drop("__at")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers from 0."""
    return _numbered(spark.read.text(path))


def read_mtx(spark: SparkSession, matrix: str, barcodes: str, genes: str) -> DataFrame:
    """Long counts (cell, gene, count) from a MatrixMarket file of genes x cells and its two name files."""
    rows = _placed(spark.read.text(matrix)).where(~F.col("value").startswith("%")).select(F.split("value", r"\s+").alias("v"), "__at")
    rows = rows.where(F.size("v") >= 3).select(F.col("v")[0].cast("long").alias("g"), F.col("v")[1].cast("long").alias("c"), F.col("v")[2].cast("double").cast("long").alias("count"), "__at")
    head = F.broadcast(rows.agg(F.min("__at").alias("__head")))  # the first line that is no comment: the sizes
    names = [_lines(spark, p).select((F.col("line") + 1).alias(k), F.split("value", "\t")[0].alias(n)) for p, k, n in ((barcodes, "c", "cell"), (genes, "g", "gene"))]
    body = rows.crossJoin(head).where("__at != __head")
    return body.join(names[0], "c").join(names[1], "g").select("cell", "gene", "count")


def read_mtx_obs(spark: SparkSession, obs: str, barcodes: str) -> DataFrame:
    """The metadata of a MatrixMarket set's cells: row n of the CSV belongs to barcode n. Another number of rows is an
    error."""
    names = _lines(spark, barcodes).select("line", F.split("value", "\t")[0].alias("cell"))
    rows = _numbered(spark.read.option("header", True).csv(obs))
    if rows.count() != names.count():
        raise ValueError("the metadata and the barcodes have different numbers of cells")
    return names.join(rows, "line").drop("line")


def read_dense_matrix(spark: SparkSession, path: str, annotation: DataFrame | None = None) -> DataFrame:
    """Long counts from a tab-separated matrix of genes x cells: split line by line, zeros dropped.

    The header is the first line of the first file. With an annotation (cell), its cells must be the same. The names
    of cells stay a table by column number, which the counts that are not 0 are joined with.
    """
    lines = _placed(spark.read.text(path))
    placed = lines.crossJoin(F.broadcast(lines.agg(F.min("__at").alias("__head"))))
    # columns are numbered from the right: the header may lack a name for the gene column
    column = (F.col("pos") - F.col("size")).alias("column")
    head = placed.where("__at = __head").select(F.split("value", "\t").alias("v")).select(F.size("v").alias("size"), F.posexplode("v").alias("pos", "cell"))
    names = written(head.select(column, "cell"), "dense-names")
    if annotation is not None:
        have, want = names.where("cell != ''").groupBy("cell").agg(F.count("*").alias("a")), annotation.groupBy("cell").agg(F.count("*").alias("b"))
        if not have.join(want, "cell", "full").where("NOT (a <=> b)").isEmpty():
            raise ValueError("the matrix and its annotation have different cells")
    body = placed.where("__at != __head").select(F.split("value", "\t").alias("v"))
    cells = body.select(F.col("v")[0].alias("gene"), F.size("v").alias("size"), F.posexplode("v").alias("pos", "count")).where("pos > 0")
    counts = cells.select(column, "gene", F.col("count").try_cast("double").cast("long").alias("count")).where("count != 0")
    return counts.join(names, "column").select("cell", "gene", "count")


def footers(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """path, length and fault of the Parquet files with the pattern; fault is null where the footer can be read.

    Tasks look at the end of each file: its mark, the footer's length, and the footer itself, which alone goes to Python.
    Files without a byte are none to Spark.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    end = F.substring("content", -8, 8)
    size = F.conv(F.hex(F.expr("concat(substring(e, 4, 1), substring(e, 3, 1), substring(e, 2, 1), substring(e, 1, 1))")), 16, 10).cast("long")
    marked = files.select("path", "length", end.alias("e"), "content").withColumn("size", size)
    sound = (F.col("length") >= 12) & (F.substring("e", 5, 4) == F.lit(b"PAR1")) & (F.col("size") <= F.col("length") - 12)
    tail = marked.select("path", "length", F.when(sound, F.expr("substring(content, cast(-(size + 8) as int))")).alias("tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            faults = []
            for own in b.column(2):
                if not own.is_valid:
                    faults.append("no Parquet footer")
                    continue
                try:
                    pq.read_metadata(pa.BufferReader(b"PAR1" + own.as_py()))
                    faults.append(None)
                except (pa.ArrowException, OSError) as e:
                    faults.append(str(e).split("\n")[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(faults, pa.string())], names=["path", "length", "fault"])

    return tail.mapInArrow(run, "path string, length long, fault string")


def read_regions(spark: SparkSession, directory: str, pattern: str, cells: DataFrame, named: int = 20) -> DataFrame:
    """Count files whose name has the pattern, one after the other, restricted to the given cells; files that cannot
    be read are reported by a warning (the first `named` of them by name; `footers` has all) and skipped."""
    ends = written(footers(spark, directory, pattern), "footers")
    for row in ends.where("fault IS NOT NULL").orderBy("path").limit(named).collect():
        warnings.warn(f"{row.path} cannot be read and is left out: {row.fault}", stacklevel=2)
    reader = spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", pattern)
    # Spark takes the schema from one file, which may be a broken one
    if sound := ends.where("fault IS NULL").agg(F.min("path")).first()[0]:
        reader = reader.schema(spark.read.parquet(sound).schema)
    return reader.parquet(directory).join(cells.select("cell"), "cell", "left_semi")
