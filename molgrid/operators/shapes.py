"""Outlines of cells: hulls and areas from molecules, rings from label rasters. One small numpy kernel for each cell."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molgrid.operators.triangulation import delaunay

RING = "ring array<struct<x:double,y:double>>"


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; fewer than three where the points are on a line."""
    p = np.unique(xy, axis=0)
    if len(p) < 3:
        return p

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = (ring - ring[0]).T  # far from the origin products would swallow the differences
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def alpha_area(xy: np.ndarray, alpha: float) -> float:
    """Area of the alpha shape: the triangles of the Delaunay triangulation with a circumradius under 1 / alpha."""
    return _area(thinned(xy, 1 / alpha), alpha) if alpha else area(hull(xy))


def _area(p: np.ndarray, alpha: float) -> float:
    """Of distinct points."""
    a, b, c = (p[t] for t in delaunay(p).T)
    size = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
    sides = np.linalg.norm(b - a, axis=1) * np.linalg.norm(c - b, axis=1) * np.linalg.norm(a - c, axis=1)
    return float(size[(size > 0) & (sides < 4 * size / alpha)].sum())


def _distinct(xy: np.ndarray) -> np.ndarray:
    """Distinct points in order of x and y."""
    p = xy[np.lexsort((xy[:, 1], xy[:, 0]))]
    return p[np.r_[True, (p[1:] != p[:-1]).any(axis=1)][: len(p)]]


def _dilated(mask: np.ndarray, wide: list[int]) -> np.ndarray:
    """Squares with a set one around them: k rows above or below, within wide[k] columns."""
    upto = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    np.cumsum(mask, axis=1, out=upto[:, 1:])
    out = np.zeros_like(mask)
    columns = np.arange(mask.shape[1])
    for k, w in enumerate(wide[: len(mask)]):
        near = upto[:, np.minimum(columns + w + 1, len(columns))] > upto[:, np.maximum(columns - w, 0)]
        out[k:] |= near[: len(mask) - k]
        out[: len(mask) - k] |= near[k:]
    return out


#: Squares to the radius, coarse to fine; the most squares of one grid; points that are not worth a grid.
_STEPS, _SQUARES, _FEW = (4, 8, 16), 1 << 22, 1000


def thinned(xy: np.ndarray, radius: float) -> np.ndarray:
    """Distinct points without those that no empty circle of this radius or more reaches: same alpha shape.

    A point may go if each disk of (a little less than) this radius around it holds one that stays. Then the same disks are
    empty with and without it, and every corner of a Delaunay triangle with such a circle, or of the hull, stays: what those
    triangles and the outside leave over, the shape, is the same. This holds for parts as well, so the parts of a cell may
    be thinned first. Disks are told by the grid squares of their centers, from coarse to fine: near squares that may hold the
    center of an empty disk all points stay for the next grid, elsewhere one of each square does.
    """
    p = _distinct(xy)
    if len(p) <= _FEW or not np.isfinite(radius):
        return p
    wide = np.ptp(p, axis=0)
    if np.prod(wide / radius + 4) * _STEPS[0] ** 2 > _SQUARES:
        side = int(wide[1] > wide[0])
        low = p[:, side] < p[:, side].min() + wide[side] / 2
        return _distinct(np.concatenate([thinned(p[low], radius), thinned(p[~low], radius)]))
    stay, open_ = p[:0], p
    for step in _STEPS:
        # in squares; what lies further out than this has no disk in reach
        r, shape = 0.999 * step, np.ceil(wide / radius * step).astype(int) + 2 * step + 3
        if np.prod(shape) > _SQUARES or len(open_) * 500 < np.prod(shape):
            break

        def square(q: np.ndarray) -> np.ndarray:
            return np.floor((q - p.min(axis=0)) / radius * step).astype(int) + step + 1  # noqa: B023

        # of each square the first open point stands for all
        own = square(open_)
        number = own[:, 0] * shape[1] + own[:, 1]
        first = np.unique(number, return_index=True)[1]
        held = np.zeros(shape, dtype=bool)
        for q in (own[first], square(stay)):
            held[q[:, 0], q[:, 1]] = True
        # squares of which each point is that near to each point of the center's, and to any point of it
        rows = np.arange(step)
        inside = [int(np.sqrt(r * r - (k + 1) ** 2)) - 1 for k in rows if r * r >= (k + 1) ** 2 + 1]
        beside = [int(np.sqrt(r * r - max(k - 1, 0) ** 2)) + 1 for k in np.arange(step + 1)]
        near = _dilated(~_dilated(held, inside), beside)
        keep = near[own[:, 0], own[:, 1]]
        stay = np.concatenate([stay, open_[first[~keep[first]]]])
        open_ = open_[keep]
    return _distinct(np.concatenate([stay, open_]))


def _tasks(pts: DataFrame) -> DataFrame:
    """Cells are dealt to a fixed number of tasks: by the bytes alone, which are few, adaptive execution would put the work of
    all cells into one or two."""
    spark = pts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return pts.where("cell_id != 0").select(F.col("cell_id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).repartition(tasks, "cell_id")


def _by_cell(pts: DataFrame) -> DataFrame:
    """A row for each cell with its molecules: bounded by the molecules of one cell."""
    return _tasks(pts).groupBy("cell_id").agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y"))


def cell_hulls(pts: DataFrame) -> DataFrame:
    """cell_id, ring: convex hulls; cells whose molecules are on a line have none."""

    def run(batches):
        for b in batches:
            rings = [hull(np.column_stack([x, y])) for x, y in zip(b["x"], b["y"])]
            keep = [len(r) > 2 for r in rings]
            yield pd.DataFrame({"cell_id": b["cell_id"][keep], "ring": [[{"x": p[0], "y": p[1]} for p in r.tolist()] for r, k in zip(rings, keep) if k]})

    return _by_cell(pts).mapInPandas(run, f"cell_id long, {RING}")


def cell_volumes(pts: DataFrame, alpha: float = 0.0, at_once: int = 1 << 18) -> DataFrame:
    """cell_id, volume: area of the alpha shape of the molecules in the plane; alpha 0 is the hull.

    Molecules come in order of their cell. A task holds about `at_once` of them, or twice those that its cell's outline needs.
    """

    def needed(parts: list[np.ndarray]) -> np.ndarray:
        xy = np.concatenate(parts)
        xy = xy[np.isfinite(xy).all(axis=1)]
        return thinned(xy, 1 / alpha) if alpha else hull(xy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, n, most = None, [], 0, at_once

        def volume() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_area(needed(parts), alpha) if alpha else area(needed(parts))], pa.float64())], names=["cell_id", "volume"])

        for b in batches:
            cell = b.column(0).to_numpy()
            xy = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2)])
            cuts = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if i == j:
                    continue
                if cell[i] != now:
                    if parts:
                        yield volume()
                    now, parts, n, most = int(cell[i]), [], 0, at_once
                parts.append(xy[i:j])
                n += j - i
                if n > most:
                    parts = [needed(parts)]
                    n = len(parts[0])
                    most = max(at_once, 2 * n)
        if parts:
            yield volume()

    return _tasks(pts).sortWithinPartitions("cell_id", "x", "y").mapInArrow(run, "cell_id long, volume double")


def _without(a: list[list[int]], b: list[list[int]]) -> list[tuple[int, int]]:
    """What is left of the sorted intervals a where the sorted intervals b are taken away; ends are not included."""
    out, k = [], 0
    for start, stop in a:
        at = start
        while k and b[k - 1][1] > at:
            k -= 1
        while k < len(b) and b[k][0] < stop:
            if b[k][0] > at:
                out.append((at, b[k][0]))
            at = max(at, b[k][1])
            k += 1
        if at < stop:
            out.append((at, stop))
    return out


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Intervals (first, last included) as sorted [start, end) that neither touch nor overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + 1)
        else:
            out.append([a, b + 1])
    return out


def border(spans: list[tuple[int, int, int]], first: int, stop: int) -> list[tuple[int, int, int, int]]:
    """Directed pieces (x, y, to x, to y) of the border of pixels given as (row, first, last), for the rows from first to stop.

    The lines above these rows are included, so spans of the row before are needed too. Along a piece, pixels lie on the
    side of a clockwise walk on the screen (rows run down). Straight pieces over several rows are one.
    """
    rows: dict[int, list] = defaultdict(list)
    for y, a, b in spans:
        if first - 1 <= y < stop:
            rows[y].append((a, b))
    own = {y: _joined(r) for y, r in rows.items()}
    out: list[tuple[int, int, int, int]] = []
    running: dict[tuple[int, bool], int] = {}  # vertical pieces that reach the current line: (x, right side) -> first row

    def close(y: int, keep: set) -> None:
        for key in [k for k in running if k not in keep]:
            x, right = key
            start = running.pop(key)
            out.append((x, start, x, y) if right else (x, y, x, start))

    for y in sorted({r for r in own if r >= first} | {r + 1 for r in own if first <= r + 1 < stop}):
        above, here = own.get(y - 1, []), own.get(y, [])
        out += [(a, y, b, y) for a, b in _without(here, above)] + [(b, y, a, y) for a, b in _without(above, here)]
        sides = {(x, right) for a, b in here for x, right in ((a, False), (b, True))}
        close(y, sides)
        for key in sides:
            running.setdefault(key, y)
        if y + 1 not in own or y + 1 >= stop:
            close(y + 1, set())
    return out


def stitched(pieces: list[tuple[int, int, int, int]]) -> list[tuple[float, float]]:
    """The longest closed border, corners only, from its first corner in order; of equally long ones the one that starts first.

    Where two borders touch in a corner, each goes around its own pixel, so pixels that only touch there are apart.
    """
    steps: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for x, y, u, v in pieces:
        steps[x, y].append((u, v))
    best: list[tuple[int, int]] = []
    longest = 0
    for start in sorted(steps):
        while steps[start]:
            path, at, to = [start], start, steps[start].pop(0)
            length = 0
            while True:
                length += abs(to[0] - at[0]) + abs(to[1] - at[1])
                came = (np.sign(to[0] - at[0]), np.sign(to[1] - at[1]))
                at = to
                if at == start and not (len(steps[at]) and _turns(came, at, steps[at])):
                    break
                path.append(at)
                ways = steps[at]
                to = ways.pop(next((k for k, w in enumerate(ways) if _turns(came, at, [w])), 0))
            if length > longest:
                best, longest = path, length
    n = len(best)

    def way(a: tuple, b: tuple) -> tuple:
        return np.sign(b[0] - a[0]), np.sign(b[1] - a[1])

    return [(float(x), float(y)) for k, (x, y) in enumerate(best) if way(best[k - 1], best[k]) != way(best[k], best[(k + 1) % n])]


def _turns(came: tuple, at: tuple, ways: list[tuple]) -> bool:
    """Does one of the ways turn around the same pixel?"""
    return any((np.sign(w[0] - at[0]), np.sign(w[1] - at[1])) == (-came[1], came[0]) for w in ways)


def outline(spans: list[tuple[int, int, int]]) -> list[tuple[float, float]]:
    """The longest closed border of pixels given as (row, first, last), corners only."""
    ys = [y for y, _, _ in spans]
    return stitched(border(spans, min(ys), max(ys) + 2))


def labels_to_polygons(spans: DataFrame, tile: int = 256) -> DataFrame:
    """cell_id, ring: the outer border of each label.

    Borders are traced in bands of `tile` rows, so a label's pixels, or spans, need not fit a task; only the pieces of its
    border, which become the ring, come together.
    """
    piece = "array<struct<x:int,y:int,u:int,v:int>>"
    band = F.explode(F.array_distinct(F.array(*[F.floor((F.col("y") + k) / tile) for k in (0, 1)]))).alias("band")
    rows = spans.where("label > 0").select("label", "y", "x_start", "x_end", band).groupBy("label", "band").agg(F.collect_list(F.struct("y", "x_start", "x_end")).alias("s"))

    def trace(batches):
        for b in batches:
            found = [border([(r["y"], r["x_start"], r["x_end"]) for r in s], k * tile, (k + 1) * tile) for k, s in zip(b["band"], b["s"])]
            yield pd.DataFrame({"label": b["label"], "p": [[dict(zip("xyuv", map(int, q))) for q in f] for f in found]})

    pieces = rows.mapInPandas(trace, f"label long, p {piece}").groupBy("label").agg(F.flatten(F.collect_list("p")).alias("p"))

    def stitch(batches):
        for b in batches:
            rings = [stitched([(q["x"], q["y"], q["u"], q["v"]) for q in p]) for p in b["p"]]
            yield pd.DataFrame({"cell_id": b["label"], "ring": [[{"x": x, "y": y} for x, y in r] for r in rings]})

    return pieces.mapInPandas(stitch, f"cell_id long, {RING}")
