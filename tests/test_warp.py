import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrelake.operators import polygons, projection, raster, warp


def image(seed, width, height, bands):
    return np.random.default_rng(seed).integers(0, 256, (bands, height, width))


def rows_of(key, img):
    return [(key, x, y, *(int(v) for v in img[:, y, x])) for y in range(img.shape[1]) for x in range(img.shape[2])]


def kernel(name, d):
    """Cubic convolution with a = -1, or the straight line between neighbours."""
    d = abs(d)
    if name == "bilinear":
        return max(0.0, 1 - d)
    return d**3 - 2 * d**2 + 1 if d <= 1 else -(d**3) + 5 * d**2 - 8 * d + 4 if d < 2 else 0.0


def brute(img, m, width, height, name):
    """Each output pixel by itself, from the kernel's formula."""
    bands, h, w = img.shape
    out = {}
    for y in range(height):
        for x in range(width):
            n = m[6] * (x + 0.5) + m[7] * (y + 0.5) + m[8]
            if n == 0:
                continue
            u, v = (m[0] * (x + 0.5) + m[1] * (y + 0.5) + m[2]) / n, (m[3] * (x + 0.5) + m[4] * (y + 0.5) + m[5]) / n
            if not (0 <= u < w and 0 <= v < h):
                continue
            if name == "nearest":
                out[x, y] = tuple(int(b) for b in img[:, math.floor(v), math.floor(u)])
                continue
            total = np.zeros(bands)
            for j in range(math.floor(v - 0.5) - 1, math.floor(v - 0.5) + 3):
                for i in range(math.floor(u - 0.5) - 1, math.floor(u - 0.5) + 3):
                    total += kernel(name, u - 0.5 - i) * kernel(name, v - 0.5 - j) * img[:, min(max(j, 0), h - 1), min(max(i, 0), w - 1)]
            out[x, y] = tuple(int(min(255, max(0, math.floor(t + 1e-9)))) for t in total)
    return out


MATRICES = [
    [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0],
    [0.75, 0.25, -3.0, -0.5, 1.25, 6.0, 0.0, 0.0, 1.0],
    [1.5, 0.125, 2.25, 0.0625, -1.0, 33.0, 0.0078125, -0.00390625, 1.0],
    [3.0, 0.0, -9.0, 0.0, 3.0, -20.0, 0.0, 0.0, 1.0],
    [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -0.0625, 0.0, 1.0],  # the horizon crosses the canvas
]


@pytest.mark.parametrize("name", ["nearest", "bilinear", "bicubic"])
def test_warps_equal_brute_force(spark, name):
    img = image(1, 37, 29, 2)
    blocks = warp.raster_blocks(spark.createDataFrame(rows_of(1, img), "f int, x int, y int, a int, b int"), ["f"], ["a", "b"], 8)
    canvases = spark.createDataFrame([(1, k, [float(v) for v in m], 37, 29) for k, m in enumerate(MATRICES)], "f int, out int, m array<double>, width int, height int")
    targets = warp.stretches(canvases, F.lit(0), F.lit(0), F.lit(43), F.lit(31), 16)
    tiles = warp.warp_tiles(targets, blocks, ["f"], ["out"], [name, name], 8)
    got = {k: {} for k in range(len(MATRICES))}
    for r in warp.tile_pixels(tiles, ["out"], ["a", "b"]).collect():
        got[r.out][r.x, r.y] = (r.a, r.b)
    for k, m in enumerate(MATRICES):
        assert got[k] == brute(img, m, 43, 31, name), k


def test_absent_blocks_are_blank_and_valid(spark):
    blocks = warp.raster_blocks(spark.createDataFrame([(1, 3, 3, 200)], "f int, x int, y int, v int"), ["f"], ["v"], 4)
    target = spark.createDataFrame([(1, 0, 0, 8, 8, 8, 8, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (2, 0, 0, 2, 2, 2, 2, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (3, 0, 0, 2, 2, 2, 2, [None] * 9)], "f int, x0 int, y0 int, x1 int, y1 int, width int, height int, m array<double>")
    rows = warp.tile_pixels(warp.warp_tiles(target, blocks, ["f"], [], ["nearest"], 4), ["f"], ["v"]).collect()
    assert {(r.f, r.x, r.y): r.v for r in rows if r.v} == {(1, 3, 3): 200} and len(rows) == 64 + 4


def test_feather_weights():
    t = warp.Target([1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], (0, 0, 6, 4), (5, 4), ["nearest"])
    assert t.feather().reshape(4, 6)[0].tolist() == [1, 1, 1, 1, 0, 0] and t.feather().reshape(4, 6)[2].tolist() == [2, 2, 2, 1, 0, 0]


def test_masks_become_footprints(spark):
    rng = np.random.default_rng(5)
    bits = rng.random((13, 21)) < 0.6
    pixels = [("a", x, y, 1) for y, x in np.argwhere(bits).tolist()]
    blocks = warp.raster_blocks(spark.createDataFrame(pixels, "id string, x int, y int, v int"), ["id"], ["v"], 8)
    m = [0.0, -1.0, 30.0, 2.0, 0.0, -4.0, 0.0, 0.0, 1.0]  # a quarter turn, twice as tall
    rows = [("a", 2, 3, 21, 13, m), ("far", 2, 3, 21, 13, [1.0, 0.0, 900.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), ("gone", 0, 0, 4, 4, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -0.25, 0.0, 1.0]), ("large", 0, 0, 4000, 4000, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])]
    masks = spark.createDataFrame(rows, "id string, x int, y int, width int, height int, m array<double>")
    bounded = warp.mask_bounds(masks, (60, 64), 3000)
    assert {r.id: r.problem for r in bounded.collect()} == {"a": None, "far": "outside", "gone": "infinite", "large": "budget"}
    found = warp.warp_masks(bounded, blocks, ["id"], 8, 10)
    want = set()
    for y in range(64):
        for x in range(60):
            u, v = (y + 0.5 + 4) / 2 - 2, 30 - (x + 0.5) - 3
            if 0 <= u < 21 and 0 <= v < 13 and bits[math.floor(v), math.floor(u)]:
                want.add((x, y))
    (row,) = found.collect()
    assert {(x, r.y) for r in row.runs for x in range(r.x1, r.x2)} == want
    assert row.runs == sorted(row.runs) and all(a.y != b.y or a.x2 < b.x1 for a, b in zip(row.runs, row.runs[1:]))
    canvas = spark.range(60 * 64).selectExpr("cast(id % 60 as int) as x", "cast(floor(id / 60) as int) as y", "1 as p")
    assert projection.clip_to_acquired(found, canvas, ["id"]).first().area == len(want)


def brute_fill(corners, width, height):
    """Pixels by the module's rule, with plain loops."""
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    left, top, right, bottom = max(0, math.floor(min(xs))), max(0, math.floor(min(ys))), min(width, math.ceil(max(xs))), min(height, math.ceil(max(ys)))
    p = [(left + int(x - left), top + int(y - top)) for x, y in corners]
    edges = list(zip(p, p[1:] + p[:1]))
    last, out = max(y for _, y in p), set()
    for y in range(top, bottom):
        at = []
        for (ax, ay), (bx, by) in edges:
            if ay == by == y:
                out |= {(x, y) for x in range(min(ax, bx), max(ax, bx) + 1)}
            elif ay != by and min(ay, by) <= y <= max(ay, by):
                x = (y - ay) * ((bx - ax) / (by - ay)) + ax
                at += [x, x] if y == max(ay, by) and y < last else [x]
        at.sort()
        for a, b in zip(at[::2], at[1::2]):
            out |= {(x, y) for x in range(math.floor(a + 0.5), math.ceil(b - 0.5) + 1)}
    return {(x, y) for x, y in out if left <= x < right and top <= y < bottom}


def test_polygons_equal_brute_force(spark):
    rng = random.Random(7)
    shapes = [
        [(2, 2), (9, 2), (9, 6), (2, 6)], [(5.5, 1.2), (10.9, 6.4), (5.1, 11.8), (0.3, 6.6)], [(1, 1), (8, 1), (8, 8), (4, 4), (1, 8)], [(0, 0), (10, 10), (10, 0), (0, 10)],  # box, diamond, notch, bow tie
        [(3, 3), (3, 3), (3, 3)], [(1, 1), (5, 1), (9, 1)], [(1, 1), (1, 9)], [(4, 2)], [(-8, -3), (30, -2), (31, 40), (-9, 41)], [(25, 2), (30, 2), (30, 9)], [(2, 2), (6, 6), (10, 2), (10, 10), (6, 6), (2, 10)],
    ]
    shapes += [[(rng.uniform(-5, 28), rng.uniform(-5, 24)) for _ in range(rng.randrange(3, 8))] for _ in range(60)] + [[(rng.randrange(-3, 24), rng.randrange(-3, 20)) for _ in range(rng.randrange(3, 9))] for _ in range(60)]
    rows = [(i, [(float(x), float(y)) for x, y in s]) for i, s in enumerate(shapes)] + [(900, None), (901, []), (902, [(1.0, None), (2.0, 3.0), (5.0, 1.0)]), (903, [None, (2.0, 3.0)])]
    found = polygons.polygon_runs(spark.createDataFrame(rows, "id int, corners array<struct<x:double,y:double>>"), ["id"], (24, 20))
    got = {r.id: r.runs for r in found.collect()}
    for i, s in enumerate(shapes):
        want = brute_fill(s, 24, 20)
        assert {(x, r.y) for r in got.get(i, []) for x in range(r.x1, r.x2)} == want, (i, s)
        assert all(a.y < b.y or (a.y == b.y and a.x2 < b.x1) for a, b in zip(got.get(i, []), got.get(i, [])[1:]))
    assert not set(got) & {900, 901, 902, 903}


def test_polygons_feed_the_footprint_operators(spark):
    square = [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)]
    rows = [(1, 1, "p", 0.9, square), (1, 2, "q", 0.8, [(x + 1, y + 1) for x, y in square]), (1, 3, "r", 0.7, [(x + 20, y) for x, y in square])]
    shapes = spark.createDataFrame(rows, "cls int, frame int, id string, conf double, corners array<struct<x:double,y:double>>")
    runs = polygons.polygon_runs(shapes, ["cls", "frame", "id", "conf"], (40, 40))
    merged = projection.dedup_footprints(runs, ["cls"], 0.5).collect()
    assert sorted(len(r.links) for r in merged) == [1, 2]
    canvas = spark.range(1600).selectExpr("cast(id % 40 as int) as x", "cast(floor(id / 40) as int) as y", "cast(id % 40 < 5 as int) as p")
    clip = {r.id: (r.x1, r.y1, r.x2, r.y2) for r in projection.clip_to_acquired(runs, canvas, ["id"]).collect()}
    assert clip == {"p": (2, 2, 5, 8), "q": (3, 3, 5, 9)}


def test_warped_tiles_blend(spark):
    """Two frames over each other: weighted means where both are valid."""
    a, b = image(2, 12, 12, 3), image(3, 12, 12, 3)
    blocks = warp.raster_blocks(spark.createDataFrame(rows_of(1, a) + rows_of(2, b), "f int, x int, y int, r int, g int, b int"), ["f"], ["r", "g", "b"], 8)
    canvases = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (2, [1.0, 0.0, -6.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "f int, m array<double>").withColumns({"width": F.lit(12), "height": F.lit(12)})
    tiles = warp.warp_tiles(warp.stretches(canvases, F.lit(0), F.lit(0), F.lit(18), F.lit(12), 8), blocks, ["f"], [], ["bilinear"] * 3, 8)
    out = {(r.x, r.y): r for r in raster.blend(warp.tile_pixels(tiles, ["f"], ["r", "g", "b"]), ["x", "y"]).collect()}
    assert len(out) == 18 * 12 and out[2, 3].coverage == 1 and out[8, 3].coverage == 2
    wa, wb = min(9, 4, 4, 4), min(3, 10, 4, 9)
    assert out[2, 3].r == a[0, 3, 2] and out[8, 3].g == (wa * a[1, 3, 8] + wb * b[1, 3, 2]) // (wa + wb)
