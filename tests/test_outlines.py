"""Outlines traced in bands and stitched, against pixels walked one by one."""

import random

import pytest

from molgrid.operators import shapes, spatial

SPANS = "y long, x_start long, x_end long, label long"


def spans_of(pixels):
    out = []
    for y in sorted({y for _, y in pixels}):
        xs = sorted(x for x, r in pixels if r == y)
        start = xs[0]
        for a, b in zip(xs, [*xs[1:], None]):
            if b != a + 1:
                out.append((y, start, a))
                start = b
    return out


def rings_by_pixels(pixels):
    """All borders, from unit steps; at a corner of two, the one around the same pixel."""
    steps = {}
    for x, y in pixels:
        for dx, dy, a, b in ((0, -1, (x, y), (x + 1, y)), (1, 0, (x + 1, y), (x + 1, y + 1)), (0, 1, (x + 1, y + 1), (x, y + 1)), (-1, 0, (x, y + 1), (x, y))):
            if (x + dx, y + dy) not in pixels:
                steps.setdefault(a, {})[b[0] - a[0], b[1] - a[1]] = (x, y)
    left, rings = {(a, d) for a, ways in steps.items() for d in ways}, []
    while left:
        a, d = min(left)
        ring = []
        while (a, d) in left:
            left.discard((a, d))
            ring.append((a, d))
            a = (a[0] + d[0], a[1] + d[1])
            turn = (-d[1], d[0])
            d = turn if turn in steps[a] else d if d in steps[a] else next(iter(steps[a]))
        rings.append({p for k, (p, way) in enumerate(ring) if ring[k - 1][1] != way})
        rings[-1] = (len(ring), rings[-1])
    return rings


def blob(rng, n, size):
    pixels = {(size // 2, size // 2)}
    while len(pixels) < n:
        x, y = rng.choice(sorted(pixels))
        dx, dy = rng.choice([(0, 1), (1, 0), (0, -1), (-1, 0), (1, 1)])
        pixels.add((min(max(x + dx, 0), size), min(max(y + dy, 0), size)))
    return pixels


@pytest.mark.parametrize("seed", range(30))
def test_bands_are_stitched_to_the_same_ring(seed):
    rng = random.Random(seed)
    pixels = blob(rng, rng.randint(1, 60), 14)
    spans = spans_of(pixels)
    want = rings_by_pixels(pixels)
    longest = max(n for n, _ in want)
    whole = shapes.outline(spans)
    assert (longest, set(whole)) in want
    for tile in (1, 2, 3, 5, 100):
        pieces = [p for k in range(-1, 20) for p in shapes.border(spans, k * tile, (k + 1) * tile)]
        assert shapes.stitched(pieces) == whole, tile


def test_one_label_over_four_tiles(spark):
    """A ring with a hole over 40 rows and bands of ten: one ring, that of one band."""
    rows = [(y, 5, 30, 7) for y in range(40) if y < 8 or y >= 31] + [(y, a, b, 7) for y in range(8, 31) for a, b in ((5, 9), (25, 30))]
    rows += [(3, 40, 40, 9), (4, 41, 41, 9)]  # pixels that touch in a corner
    spans = spark.createDataFrame(rows, SPANS).repartition(5)
    tiled, whole = ({r.cell_id: [(p.x, p.y) for p in r.ring] for r in shapes.labels_to_polygons(spans, tile).collect()} for tile in (10, 1000))
    assert tiled == whole and tiled[7] == [(5, 0), (31, 0), (31, 40), (5, 40)] and len(tiled[9]) == 4


def test_tall_polygons_are_scanned_in_bands(spark):
    ring = [{"x": 3.2, "y": -4.0}, {"x": 40.7, "y": 11.0}, {"x": 22.0, "y": 95.5}, {"x": 1.0, "y": 60.0}]
    poly = spark.createDataFrame([(1, ring), (2, [{"x": p["x"] + 9, "y": p["y"] + 3} for p in ring])], f"cell_id long, {shapes.RING}")
    a, b = ({tuple(r) for r in spatial.rasterize(poly, 60, 90, band).collect()} for band in (7, 1024))
    assert a == b and len(a) > 90
