"""Coordinates, boxes and rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molgrid.functions.scalars import Matrix, affine

Box = tuple[float, float, float, float]  # min x, min y, max x, max y


def to_global(pts: DataFrame, matrix: Matrix, names: tuple[str, str] = ("gx", "gy")) -> DataFrame:
    """Adds global coordinates."""
    x, y = F.col("x"), F.col("y")
    return pts.withColumns({names[0]: affine(matrix, 0, x, y), names[1]: affine(matrix, 1, x, y)})


def to_frame(pts: DataFrame, dx: float, dy: float) -> DataFrame:
    """Coordinates in the frame of a raster whose origin is at (dx, dy)."""
    return pts.withColumns({"x": F.col("x") - dx, "y": F.col("y") - dy})


def _in_box(x: Column, y: Column, box: Box) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def crop_points(pts: DataFrame, matrix: Matrix, box: Box) -> DataFrame:
    """Points in a closed box of global coordinates, with their own columns only.

    Where the matrix has no rotation the box is brought to the points' coordinates, so that the filter reaches the
    file statistics.
    """
    (a, b, dx), (c, d, dy) = matrix[0], matrix[1]
    if not b and not c and a and d:
        xs = sorted(((box[0] - dx) / a, (box[2] - dx) / a))
        ys = sorted(((box[1] - dy) / d, (box[3] - dy) / d))
        return pts.where(_in_box(F.col("x"), F.col("y"), (xs[0], ys[0], xs[1], ys[1])))
    x, y = F.col("x"), F.col("y")
    return pts.where(_in_box(affine(matrix, 0, x, y), affine(matrix, 1, x, y), box))


def edges(ring: Column) -> Column:
    """Consecutive corner pairs, the last with the first; one expression over the array, no join."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace formula."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def ring_centroid(ring: Column) -> Column:
    """Centroid (x, y) of a ring; the mean corner where it has no area."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"))

    def step(acc, e):
        w = e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
        return F.struct(
            (acc["x"] + w * (e["a"]["x"] + e["b"]["x"])).alias("x"),
            (acc["y"] + w * (e["a"]["y"] + e["b"]["y"])).alias("y"),
            (acc["w"] + w).alias("w"),
        )

    def mean(axis: str) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(ring)

    sums = F.aggregate(edges(ring), zero, step)
    return F.struct(
        F.when(sums["w"] != 0, F.try_divide(sums["x"], 3 * sums["w"])).otherwise(mean("x")).alias("x"),
        F.when(sums["w"] != 0, F.try_divide(sums["y"], 3 * sums["w"])).otherwise(mean("y")).alias("y"),
    )


def crop_shapes(poly: DataFrame, matrix: Matrix, box: Box) -> DataFrame:
    """Shapes whose centroid lies in the closed box of global coordinates."""
    at = poly.withColumn("__c", ring_centroid(F.col("ring")))
    x, y = F.col("__c.x"), F.col("__c.y")
    return at.where(_in_box(affine(matrix, 0, x, y), affine(matrix, 1, x, y), box)).drop("__c")


def crop_region(pts: DataFrame, poly: DataFrame, cells: DataFrame, box: Box) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points and shapes of a fixed region, and the cells that still have a shape."""
    unit = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    shapes = crop_shapes(poly, unit, box)
    return crop_points(pts, unit, box), shapes, cells.join(shapes.select("cell_id"), "cell_id", "left_semi")


def extent(df: DataFrame) -> DataFrame:
    return df.agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def tissue_center(pts: DataFrame, matrix: Matrix, width: float, height: float, accuracy: int | None = None) -> DataFrame:
    """Median of the global coordinates on each axis; the middle of the image where there are no points.

    accuracy: approximate percentiles with this accuracy, for tables whose exact median is too costly.
    """
    g = to_global(pts, matrix)
    if accuracy is not None:
        found = g.agg(*[F.percentile_approx(c, 0.5, accuracy).cast("double").alias(c) for c in ("gx", "gy")])
    else:
        found = medians(g, "gx", "gy")
    return found.select(F.coalesce("gx", F.lit(width / 2)).alias("center_x"), F.coalesce("gy", F.lit(height / 2)).alias("center_y"))


def medians(df: DataFrame, *cols: str, accuracy: int = 10_000) -> DataFrame:
    """One row with the exact median of each column, null where it has no value.

    A sketch brackets the median by two values whose ranks lie within a few of `accuracy` parts of it; a second pass
    counts the rows below, and those between by value. So no task holds more than about 8 / accuracy of the rows,
    and equal values are one. A bracket that missed the median is an error.
    """
    span = 4 / accuracy
    ends = df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(F.lit(0.5 - span), F.lit(0.5 + span)), F.lit(accuracy)).alias(c) for c in cols])
    ends = ends.select(F.posexplode(F.array(*cols)).alias("k", "e"))
    ends = ends.select("k", F.get("e", F.lit(0)).alias("low"), F.get("e", F.lit(1)).alias("high"))
    values = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("k", "v")).where("v IS NOT NULL")
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    met = values.join(F.broadcast(ends), "k").withColumn("side", side)
    counts = met.groupBy("k", "side", F.when(F.col("side") == 0, F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("k")
    upto = F.sum("n").over(whole.orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select("k", "side", "v", "n", upto.alias("upto"), F.sum("n").over(whole).alias("all"))

    def at(rank: Column) -> Column:
        holds = (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
        return F.max(F.when(holds, F.when(F.col("side") != 0, F.raise_error(F.lit("medians: the bracket missed the median"))).otherwise(F.col("v"))))

    last = F.col("all") - 1
    middle = ranked.groupBy("k").agg(at(F.floor(last / 2)).alias("a"), at(F.ceil(last / 2)).alias("b")).select("k", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("a") + F.col("b")) / 2).alias("v"))
    return middle.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(c) for k, c in enumerate(cols)])


def crop_window(centers: DataFrame, width: int, height: int, max_pixels: int) -> DataFrame:
    """x, y, w, h of the crop around center_x, center_y: the whole image where it is small enough, else a square,
    stretched along an axis where it exceeds the other side, moved into the image and truncated."""
    if width * height <= max_pixels:
        return centers.select(*[F.lit(v).cast("long").alias(k) for k, v in (("x", 0), ("y", 0), ("w", width), ("h", height))])
    side = int(max_pixels**0.5)
    w, h = min(side, width), min(side, height)
    if w < side:
        h = min(height, max_pixels // w)
    elif h < side:
        w = min(width, max_pixels // h)

    def offset(center: str, size: int, whole: int) -> Column:
        return F.greatest(F.least(F.col(center) - size / 2, F.lit(float(whole - size))), F.lit(0.0)).cast("long")

    return centers.select(
        offset("center_x", w, width).alias("x"), offset("center_y", h, height).alias("y"), F.lit(w).cast("long").alias("w"), F.lit(h).cast("long").alias("h")
    )


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside: even-odd rule, and not on an edge."""
    return inside_edges(x, y, edges(ring))


def inside_edges(x: Column, y: Column, sides: Column) -> Column:
    """The same for the edges of a ring."""

    def crosses(e):
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return F.when((a["y"] > y) != (b["y"] > y), F.when(x < at, 1).otherwise(0)).otherwise(0)

    def touches(e):
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (
            (cross == 0)
            & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
            & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        )

    odd = F.aggregate(sides, F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1
    return odd & ~F.exists(sides, touches)
