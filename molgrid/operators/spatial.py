"""Joins of molecules with rasters, polygons, bins and tiles: range conditions rewritten to equal grid keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molgrid.functions.scalars import bin_label, bin_pixels, clamp
from molgrid.operators.geometry import edges, inside_edges
from molgrid.sources.writers import written


def _in_grid(pts: DataFrame, side: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """`pts` left-joined with `side` (one row for each grid cell) on the grid keys; crowded grid cells are shared out.

    A grid cell with more than rows_per_task points gets as many salts as it needs: its points are dealt to them and its
    row is copied to each. There are no more crowded cells than points over rows_per_task, and only those are broadcast.
    """
    crowded = pts.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > rows_per_task)
    crowded = F.broadcast(crowded.select(*keys, F.ceil(F.col("n") / rows_per_task).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    # by the whole row, so that a repeated task deals as before
    row = F.xxhash64(*[c for c, t in pts.dtypes if "map<" not in t])
    dealt = pts.join(crowded, keys, "left").withColumn("__salt", F.pmod(row, salts).cast("int")).drop("__salts")
    copied = side.join(crowded, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(copied, [*keys, "__salt"], "left").drop("__salt")


def assign_by_labels(pts: DataFrame, spans: DataFrame, width: int, height: int, bucket: int = 64, rows_per_task: int = 1_000_000) -> DataFrame:
    """cell_id from a label raster in spans (y, x_start, x_end, label); 0 is background, larger labels win.

    Coordinates are truncated and clamped. Spans are cut at bucket bounds and stand together for each (row, bucket), so
    each point meets one row at most: one join, no grouping of points. Clamping may heap points up at the border;
    crowded buckets are shared out.
    """
    at = pts.withColumns({"__x": clamp(F.col("x").cast("long"), 0, width - 1), "__y": clamp(F.col("y").cast("long"), 0, height - 1)})
    at = at.withColumn("__b", F.floor(F.col("__x") / bucket)).drop("cell_id")
    parts = spans.where("label > 0").select(
        F.col("y").cast("long").alias("__y"),
        F.explode(F.sequence(F.floor(F.col("x_start") / bucket), F.floor(F.col("x_end") / bucket))).alias("__b"),
        F.struct("x_start", "x_end", "label").alias("span"),
    ).groupBy("__y", "__b").agg(F.collect_list("span").alias("__spans"))
    over = F.filter("__spans", lambda s: F.col("__x").between(s["x_start"], s["x_end"]))
    label = F.coalesce(F.array_max(F.transform(over, lambda s: s["label"])), F.lit(0)).cast("long")
    return _in_grid(at, parts, ["__y", "__b"], rows_per_task).withColumn("cell_id", label).drop("__x", "__y", "__b", "__spans")


def assign_by_polygons(pts: DataFrame, poly: DataFrame, cell_size: float, unassigned: int | None = None, rows_per_task: int = 1_000_000) -> DataFrame:
    """cell_id of the polygon that a point lies strictly inside; of several the one with the smallest id.

    Every point stays, once; without a polygon cell_id is null, or `unassigned`. Polygons are copied to the grid cells
    that their boxes touch, with box and edges worked out once, and each point meets the one row of its own grid cell:
    one join, no grouping of points; crowded grid cells are shared out. A point is tried against the boxes in the order of
    ids and against the edges of a polygon only inside of its box; later polygons are left out once one holds it.
    """
    def axis(c: str, of) -> F.Column:
        return of(F.transform("ring", lambda p: p[c]))

    sides = (("lx", "x", F.array_min), ("hx", "x", F.array_max), ("ly", "y", F.array_min), ("hy", "y", F.array_max))
    box = poly.select("cell_id", edges(F.col("ring")).alias("edges"), *(axis(c, of).alias(n) for n, c, of in sides))
    grid = {n: F.floor(F.col(n) / cell_size) for n, _, _ in sides}
    tiles = box.select("*", F.explode(F.sequence(grid["lx"], grid["hx"])).alias("__gx"))
    tiles = tiles.select("__gx", F.explode(F.sequence(grid["ly"], grid["hy"])).alias("__gy"), F.struct("cell_id", "lx", "hx", "ly", "hy", "edges").alias("p"))
    near = tiles.groupBy("__gx", "__gy").agg(F.sort_array(F.collect_list("p")).alias("__near"))
    at = pts.drop("cell_id").withColumns({"__gx": F.floor(F.col("x") / cell_size), "__gy": F.floor(F.col("y") / cell_size)})
    x, y = F.col("x"), F.col("y")
    boxed = F.filter("__near", lambda p: (x > p["lx"]) & (x < p["hx"]) & (y > p["ly"]) & (y < p["hy"]))
    none = F.lit(None).cast(dict(poly.dtypes)["cell_id"])
    first = F.aggregate(boxed, none, lambda found, p: F.when(found.isNull(), F.when(inside_edges(x, y, p["edges"]), p["cell_id"])).otherwise(found))
    out = _in_grid(at, near, ["__gx", "__gy"], rows_per_task).withColumn("cell_id", first).drop("__gx", "__gy", "__near")
    return out if unassigned is None else out.withColumn("cell_id", F.coalesce("cell_id", F.lit(unassigned)))


def assign_by_bins(pts: DataFrame, width: int, bin_size: int, bin_size_um: float | None = None, pixel_um: float = 1.0) -> DataFrame:
    """cell_id is the square bin of the point: arithmetic only."""
    return pts.withColumn("cell_id", bin_label(F.col("x"), F.col("y"), bin_pixels(bin_size_um, bin_size, pixel_um), width).cast("long"))


def sweep_bins(pts: DataFrame, sizes: list[int], width: int) -> DataFrame:
    """Molecules and bins for each of several bin sizes, in one pass over the points."""
    size = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("bin_size")
    rows = pts.select("x", "y", size)
    per_row = F.ceil(F.lit(width) / F.col("bin_size"))
    label = F.floor(F.floor("y") / F.col("bin_size")) * per_row + F.floor(F.floor("x") / F.col("bin_size")) + 1
    bins = rows.groupBy("bin_size", label.alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("bin_size").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_molecules"), F.max("n").alias("largest"))


def tile_points(pts: DataFrame, width: float, overlap: float, min_pts: int, rows_per_task: int = 1_000_000) -> DataFrame:
    """Points copied into every tile whose window with its margin holds them; tiles with few points go. Crowded tiles are
    shared out where points meet the tiles that stay."""
    def tiles(c: str) -> F.Column:
        return F.sequence(F.floor((F.col(c) - overlap) / width), F.floor((F.col(c) + overlap) / width))

    copied = pts.withColumn("tile_x", F.explode(tiles("x"))).withColumn("tile_y", F.explode(tiles("y")))
    full = copied.groupBy("tile_x", "tile_y").agg((F.count("*") >= min_pts).alias("__full")).where("__full")
    return _in_grid(copied, full, ["tile_x", "tile_y"], rows_per_task).where("__full").drop("__full").select(*copied.columns)


def use_labels(layers: dict[str, DataFrame], key: str) -> DataFrame:
    """The label spans of the given key."""
    if key not in layers:
        raise ValueError(f"no labels named {key!r}: {sorted(layers)}")
    return layers[key]


def fov_neighbours(fovs: DataFrame, size: float) -> DataFrame:
    """Pairs of fields of view that overlap to the right, below or diagonally, by a join on grid cells of their size."""
    at = fovs.withColumns({"__gx": F.floor(F.col("x") / size), "__gy": F.floor(F.col("y") / size)})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (-1, 0, 1)])).alias("d")
    left = at.select(F.col("fov").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "__gx", "__gy", near)
    left = left.withColumns({"__gx": F.col("__gx") + F.col("d.i"), "__gy": F.col("__gy") + F.col("d.j")})
    right = at.select(F.col("fov").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "__gx", "__gy")
    pairs = left.join(right, ["__gx", "__gy"]).where("a != b")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    kept = pairs.where((dx >= 0) & (dx < size) & (F.abs(dy) < size) & ((dx > 0) | (dy > 0)))
    kind = F.when(dy == 0, "right").when(dx == 0, "bottom").otherwise("diagonal")
    return kept.select("a", "b", kind.alias("side"))


def rasterize(poly: DataFrame, width: int, height: int, band: int = 1024) -> DataFrame:
    """Spans (y, x_start, x_end, label) of the pixels whose centre lies in a polygon; later labels win.

    Each polygon is scanned by itself, tall ones in bands of rows; rows that several polygons share are then settled row
    by row.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for label, ring, first in zip(b["label"], b["ring"], b["first"]):
                xs, ys = np.array([p["x"] for p in ring]), np.array([p["y"] for p in ring])
                nx, ny = np.roll(xs, -1), np.roll(ys, -1)
                for y in range(max(first, int(np.floor(ys.min()))), min(first + band - 1, height - 1, int(np.ceil(ys.max()))) + 1):
                    c = y + 0.5
                    up = (ys > c) != (ny > c)
                    at = np.sort((nx - xs)[up] * (c - ys[up]) / (ny - ys)[up] + xs[up])
                    for a, e in zip(at[::2], at[1::2]):
                        s, t = max(0, int(np.ceil(a - 0.5))), min(width - 1, int(np.ceil(e - 0.5)) - 1)
                        if s <= t:
                            out.append((y, s, t, label))
            yield pd.DataFrame(out, columns=["y", "x_start", "x_end", "label"])

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        bounds = np.unique(np.r_[rows["x_start"], rows["x_end"] + 1])
        owner = np.zeros(len(bounds) - 1, dtype=np.int64)
        for s, t, label in sorted(zip(rows["x_start"], rows["x_end"], rows["label"]), key=lambda r: r[2]):
            owner[np.searchsorted(bounds, s) : np.searchsorted(bounds, t + 1)] = label
        new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out = pd.DataFrame({"y": rows["y"].iloc[0], "x_start": bounds[new], "x_end": bounds[np.r_[new[1:], len(owner)]] - 1, "label": owner[new]})
        return out[out["label"] > 0]

    kinds = "y long, x_start long, x_end long, label long"
    ys = F.transform("ring", lambda p: p["y"])
    low, high = F.greatest(F.lit(0), F.floor(F.array_min(ys) / band)), F.least(F.lit((height - 1) // band), F.floor(F.ceil(F.array_max(ys)) / band))
    bands = poly.where(F.size("ring") > 0).select(F.col("cell_id").alias("label"), "ring", low.alias("low"), high.alias("high")).where("low <= high")
    spans = bands.select("label", "ring", F.explode(F.transform(F.sequence("low", "high"), lambda k: k * band)).alias("first")).mapInPandas(scan, kinds)
    return spans.groupBy("y").applyInPandas(settle, kinds)


GRID = {"__gx": "x", "__gy": "y"}


def near_lists(b: DataFrame, radius: float) -> DataFrame:
    """__gx, __gy, __near: for each grid cell of that size the rows of b (id, x, y) that a point in it may reach.

    Written once, so that Spark knows whether the table is small. Such a list must fit a task.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    right = b.select(F.struct(F.col("id").alias("neighbour"), "x", "y").alias("p"), *[F.floor(F.col(c) / radius).alias(n) for n, c in GRID.items()]).where("__gx IS NOT NULL AND __gy IS NOT NULL")
    right = right.withColumn("d", around).withColumns({n: F.col(n) + F.col(f"d.{c}") for n, c in (("__gx", "i"), ("__gy", "j"))})
    return written(right.groupBy("__gx", "__gy").agg(F.collect_list("p").alias("__near")), "near")


def nearest(a: DataFrame, lists: DataFrame, k: int, radius: float) -> DataFrame:
    """Adds `near` to the rows of a: the k nearest of the lists' rows within `radius`, nearest first, as (distance,
    neighbour). A row meets one list and sorts its own few: rows are shuffled for that join at most, and not at all where
    the lists are small.
    """

    def apart(p: F.Column) -> F.Column:
        distance = F.sqrt((F.col("x") - p["x"]) ** 2 + (F.col("y") - p["y"]) ** 2)
        return F.struct(distance.alias("distance"), p["neighbour"].alias("neighbour"))

    within = F.filter(F.transform("__near", apart), lambda p: p["distance"] <= radius)
    grid = {n: F.floor(F.col(c) / radius) for n, c in GRID.items()}
    return a.withColumns(grid).join(lists, ["__gx", "__gy"], "left").withColumn("near", F.slice(F.sort_array(within), 1, k)).drop("__gx", "__gy", "__near")


def spatial_knn(a: DataFrame, b: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest rows of b (id, x, y) within `radius` of each row of a, by grid cells of that size."""
    met = nearest(a.select("id", "x", "y"), near_lists(b, radius), k, radius).select("id", F.posexplode("near").alias("rank", "p"))
    return met.select("id", "p.neighbour", "p.distance", (F.col("rank") + 1).alias("rank"))
