"""Operators against closed-form values and plain loops."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gyrelake.functions import geometry as G
from gyrelake.functions import text as X
from gyrelake.operators import alignment, evidence, merge, projection, raster, registration, slicing


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_windows_of_a_large_frame(spark):
    got = slicing.slice_windows(spark.createDataFrame([(0, 6560, 4948)], "frame int, width int, height int")).orderBy("slice_index").collect()
    assert len(got) == 63 and [r.x for r in got[:9]] == list(range(0, 5249, 656))
    last = got[-1]
    assert (last.x, last.y, last.valid_width, last.valid_height) == (5248, 3636, 1312, 1312)


def test_batches_keep_the_short_one(spark):
    windows = slicing.slice_windows(spark.createDataFrame([(0, 2000, 1312)], "frame int, width int, height int"))
    sizes = slicing.batches(windows, 2).groupBy("batch_index").count().orderBy("batch_index").collect()
    assert [r["count"] for r in sizes] == [2, 1]


def merged(spark, width, height, boxes, threshold=0.5):
    frames = spark.createDataFrame([(0, width, height)], "frame int, width int, height int")
    d = spark.createDataFrame([(0, *b) for b in boxes], "frame int, slice_index int, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    windows = slicing.slice_windows(frames)
    assert slicing.unknown_slices(windows, d).isEmpty()
    out = merge.merge_boxes(slicing.map_and_clip(windows, d, frames), ["frame", "cls"], threshold).orderBy("cls", "x1", "y1").collect()
    return [((r.x1, r.y1, r.x2, r.y2), r.conf, r.slices) for r in out]


def plain_merge(boxes, width, height, threshold):
    """Boxes of one class in frame coordinates, merged by a plain loop: (x1, y1, x2, y2, conf, slices)."""
    live = [[max(0, x1), max(0, y1), min(width, x2), min(height, y2), conf, {s}] for s, conf, x1, y1, x2, y2 in boxes]
    live = [b for b in live if b[0] < b[2] and b[1] < b[3]]
    live.sort(key=lambda b: -b[4])
    out = []
    while live:
        top = live.pop(0)
        rest = []
        for b in live:
            both = max(0, min(top[2], b[2]) - max(top[0], b[0])) * max(0, min(top[3], b[3]) - max(top[1], b[1]))
            area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
            if both / min(area(top), area(b)) >= threshold:
                top = [min(top[0], b[0]), min(top[1], b[1]), max(top[2], b[2]), max(top[3], b[3]), max(top[4], b[4]), top[5] | b[5]]
            else:
                rest.append(b)
        live = rest
        out.append(((*top[:4],), top[4], sorted(top[5])))
    return sorted(out)


@pytest.mark.parametrize("width,height,along", [(3280, 1312, 0), (1312, 3280, 1)])
def test_merges_across_tiles(spark, width, height, along):
    """A bar over three tiles of a frame, seen in pieces, a box that sticks out of the frame, and one wholly outside."""
    seen, placed = [], []
    for tile, conf, lo, hi in [(0, 0.71, 880, 1310), (1, 0.64, 700, 1900), (2, 0.33, 1330, 2200)]:
        box = [lo, 417.0, hi, 455.0] if along == 0 else [417.0, lo, 455.0, hi]
        placed.append((tile, conf, *map(float, box)))
        shift = 656 * tile
        moved = [box[0] - shift * (along == 0), box[1] - shift * (along == 1), box[2] - shift * (along == 0), box[3] - shift * (along == 1)]
        seen.append((tile, 3, conf, *map(float, moved)))
    for conf, box in [(0.52, (-9.0, 1200.0, 61.0, 1400.0)), (0.9, (1400.0, 1400.0, 1500.0, 1500.0))]:
        seen.append((0, 3, conf, *box))
        if conf < 0.9:  # the other lies outside its tile
            placed.append((0, conf, box[0], box[1], box[2], min(box[3], 1312.0)))
    got = [(tuple(b), c, list(s)) for b, c, s in merged(spark, width, height, seen, 0.4)]
    assert sorted(got) == plain_merge(placed, width, height, 0.4)


def test_greedy_is_not_a_closure():
    box = lambda *b: (*map(float, b), 0.5, frozenset([0]))
    got = merge.greedy([box(10, 3, 18, 8), box(0, 6, 9, 17), box(1, 2, 12, 14), box(4, 1, 16, 7)], 0.5)
    assert [g[:4] for g in got] == [(4, 1, 18, 8), (0, 2, 12, 17)]
    got = merge.greedy([box(12, 11, 15, 15), box(11, 3, 12, 13), box(1, 7, 12, 11), box(11, 2, 16, 9)], 0.5)
    assert (11, 2, 16, 13) in [g[:4] for g in got] and (12, 11, 15, 15) in [g[:4] for g in got]


def test_views_of_one_spot_become_one(spark):
    """Five frames see one spot and two another; expected values by sets of pixels."""
    views = [(f, f"v{f}", 0.31 + 0.07 * f, 4, 7 + f % 2, 11, 19 + f % 2, 16) for f in range(5)] + [(f, f"w{f}", 0.9 - 0.1 * f, 4, 60, 3, 66, 12 + f) for f in range(2)]
    boxes = spark.createDataFrame(views, "frame int, id string, conf double, cls int, x1 int, y1 int, x2 int, y2 int")
    got = projection.dedup_footprints(projection.box_runs(boxes, ["frame", "id", "conf", "cls"]), ["cls"], 0.6).orderBy("x1").collect()
    for r, name in zip(got, "vw", strict=True):
        mine = [v for v in views if v[1][0] == name]
        pixels = {(x, y) for *_, x1, y1, x2, y2 in mine for x in range(x1, x2) for y in range(y1, y2)}
        assert r.area == len(pixels) and r.conf == pytest.approx(max(v[2] for v in mine)) and r.links == [f"{v[0]}:{v[1]}" for v in mine]
        assert (r.x1, r.y1, r.x2, r.y2) == (min(x for x, _ in pixels), min(y for _, y in pixels), max(x for x, _ in pixels) + 1, max(y for _, y in pixels) + 1)


def test_clip_to_provenance(spark):
    """Only pixels that some frame acquired stay: a slanted edge cuts one box, another lies beyond it."""
    cut = lambda x, y: 3 * x + y < 90
    boxes = [("cut", 12, 4, 33, 15), ("gone", 31, 20, 39, 26)]
    seen = spark.createDataFrame([(x, y, int(cut(x, y))) for x in range(45) for y in range(30)], "x int, y int, p int")
    runs = projection.box_runs(spark.createDataFrame(boxes, "id string, x1 int, y1 int, x2 int, y2 int"), ["id"])
    left = [(x, y) for x in range(12, 33) for y in range(4, 15) if cut(x, y)]
    want = ("cut", min(x for x, _ in left), min(y for _, y in left), max(x for x, _ in left) + 1, max(y for _, y in left) + 1, len(left))
    assert rows(projection.clip_to_acquired(runs, seen, ["id"])) == [want]


RUNS = "runs array<struct<y int, x1 int, x2 int>>"


def plain_dedup(views, threshold):
    """The greedy rule over sets of pixels: (frame, id, conf, pixels) in, (pixels, conf, links) out."""
    box = lambda p: (min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p) + 1, max(y for _, y in p) + 1)
    names = lambda links: projection.stable_id(2, links)
    waiting = sorted(((-conf, box(p), names([(f, i)]), p, [(f, i)]) for f, i, conf, p in views), key=lambda v: v[:3])
    out = []
    while waiting:
        conf, _, _, pixels, links = waiting.pop(0)
        before = -1
        while before != len(links):
            before, rest = len(links), []
            for w in waiting:
                n = len(pixels & w[3])
                if n and max(n / len(pixels | w[3]), n / min(len(pixels), len(w[3]))) >= threshold:
                    pixels, links, conf = pixels | w[3], sorted(links + w[4]), min(conf, w[0])
                else:
                    rest.append(w)
            waiting = rest
        out.append((*box(pixels), -conf, len(pixels), [f"{f}:{i}" for f, i in links]))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_dedup_equals_a_plain_loop(spark, threshold):
    """Boxes at whole size with ties of confidence and repeated boxes, and one L-shaped footprint."""
    draw = random.Random(11)
    views = []
    for i in range(60):
        x, y = draw.randrange(70), draw.randrange(50)
        views.append((i % 16, f"p{i}", draw.randrange(4) / 4, [(line, x, x + 5 + i % 45) for line in range(y, y + 6 + i % 31)]))
    views += [(3, "twin", *views[7][2:]), (4, "bent", 0.75, [(line, 10, 14 if line < 30 else 60) for line in range(10, 40)])]
    runs = spark.createDataFrame([(f, i, c, 2, lines) for f, i, c, lines in views], f"frame int, id string, conf double, cls int, {RUNS}")
    got = sorted((r.x1, r.y1, r.x2, r.y2, r.conf, r.area, r.links) for r in projection.dedup_footprints(runs, ["cls"], threshold).collect())
    assert got == plain_dedup([(f, i, c, {(x, y) for y, x1, x2 in lines for x in range(x1, x2)}) for f, i, c, lines in views], threshold)
    assert projection.dedup_footprints(runs.limit(0), ["cls"], threshold).count() == 0


def test_overlaps_and_clips_of_bent_footprints(spark):
    """Runs of two acquisitions with canvases of their own; expected values by sets of pixels."""
    shapes = {(a, k): {(x, y) for x in range(40) for y in range(20) if (x - 9 * k - a) ** 2 < 60 + 5 * y and (y + k) % 5} for a in (0, 1) for k in range(4)}
    runs = []
    for (a, k), pixels in shapes.items():
        on = {y: [x for x, py in pixels if py == y] for y in {y for _, y in pixels}}
        runs += [(a, k, [(y, min(xs), max(xs) + 1) for y, xs in on.items()])]
    runs = spark.createDataFrame(runs, f"acq int, ord int, {RUNS}")
    want = [(a, i, j, len(shapes[a, i] & shapes[a, j])) for a in (0, 1) for i in range(4) for j in range(i + 1, 4) if shapes[a, i] & shapes[a, j]]
    assert rows(projection.footprint_overlaps(runs, ["acq"], "ord")) == want
    seen = {(a, x, y) for a in (0, 1) for x in range(40) for y in range(20) if (x // 3 + y + a) % 2}
    provenance = spark.createDataFrame([(a, x, y, int((a, x, y) in seen)) for a in (0, 1) for x in range(40) for y in range(20)], "acq int, x int, y int, p int")
    want = []
    for (a, k), pixels in shapes.items():
        left = [(x, y) for x, y in pixels if (a, x, y) in seen]
        want.append((a, k, min(x for x, _ in left), min(y for _, y in left), max(x for x, _ in left) + 1, max(y for _, y in left) + 1, len(left)))
    assert rows(projection.clip_to_acquired(runs, provenance, ["acq", "ord"], ["acq"])) == sorted(want)


def test_budget_and_hull(spark):
    sizes = spark.createDataFrame([(0, i, 100) for i in range(3)], "g int, o int, size int")
    assert [r.within for r in projection.running_budget(sizes, ["g"], ["o"], "size", 250).orderBy("o").collect()] == [True, True, False]
    assert projection.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_scalars(spark):
    one = spark.range(1)
    m = F.array(*map(F.lit, [1.0, 0.0, 10.0, 0.0, 1.0, 20.0, 0.001, 0.0, 1.0]))
    p = one.select(G.map_point(m, F.lit(5.0), F.lit(6.0)).alias("p")).first().p
    assert (p.x, p.y) == pytest.approx((15 / 1.005, 26 / 1.005))
    got = one.select(G.wrap_degrees(F.lit(-190.0)), G.circular_difference(F.lit(350.0), F.lit(10.0)), G.is_inverse(G.rotation_about(F.lit(3.0), F.lit(4.0), F.lit(30.0)), G.rotation_about(F.lit(3.0), F.lit(4.0), F.lit(-30.0)))).first()
    assert tuple(got) == (170.0, -20.0, True)
    a = math.radians(22.5)
    affine = [math.cos(a), -math.sin(a), 150 - 150 * math.cos(a) - 500 * math.sin(a), math.sin(a), math.cos(a), -500 - 150 * math.sin(a) + 500 * math.cos(a)]
    c = one.select(G.rotation_center(F.array(*map(F.lit, affine))).alias("c")).first().c
    assert (c.x, c.y) == pytest.approx((150, -500))
    assert one.select(G.rotation_center(F.array(*map(F.lit, [1.0, 0.0, 5.0, 0.0, 1.0, 5.0])))).first()[0] is None
    near = one.select(G.ray_interval(*map(F.lit, [0.0, 0.0, 2.0, -1.0, 5.0, 1.0, 0.0])).alias("r")).first().r
    assert (near.near, near.far) == (2.0, 5.0)


def test_names_and_paths(spark):
    names = ["DISC-0042_01.jpg", "disc-0042_16.JPG", "DISC-0042_00.jpg", "DISC-0042_17.jpg", "DISC-0042_1.jpg", "DISC-0042_01.png", "../DISC_01.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.m and (r.m.cycle, r.m.position) for r in df.select(X.match_template(F.col("name"), "{cycle}_{position}.jpg", 2).alias("m")).collect()]
    assert got == [("DISC-0042", 1), ("disc-0042", 16), None, None, None, None, None]
    far = spark.createDataFrame([("c" * 128 + "_01.jpg",), ("c" * 129 + "_01.jpg",), ("A_01.jpg\n",)], "name string")
    assert [r.m is not None for r in far.select(X.match_template(F.col("name"), "{cycle}_{position}.jpg", 2).alias("m")).collect()] == [True, False, False]
    sums = spark.createDataFrame([("a" * 64,), ("a" * 63,), ("A" * 64,), ("a" * 64 + "\n",)], "s string")
    assert [r[0] for r in sums.select(X.checksum_ok(F.col("s"))).collect()] == [True, False, True, False]
    ids = spark.createDataFrame([("a.b-1",), ("-a",), ("a" * 129,), ("a\n",), ("",)], "s string")
    assert [r[0] for r in ids.select(X.identifier_ok(F.col("s"))).collect()] == [True, False, False, False, False]
    with pytest.raises(ValueError):
        X.template_pattern("{cycle}.jpg", 2)
    paths = {"a/b.png": None, "": "empty", "/a": "absolute", "C:x": "drive", "a\\b": "backslash", "a/../b": "part", "a//b": "part", "a./b": "trailing", "a<b": "character", "x/nul.txt": "reserved", " ok ": None}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.path_problem(F.col("p")).alias("r")).collect()
    assert {r.p: r.r for r in got} == paths
    assert [r[0] for r in spark.createDataFrame([("12a",), ("a1",), ("",)], "n string").select(X.leading_number(F.col("n"))).collect()] == [12, None, None]


def test_split_is_the_same_in_any_order(spark):
    grid = [(0, float(x), float(y), i) for i, (x, y) in enumerate((x, y) for x in range(0, 600, 50) for y in range(0, 400, 40))]
    split = lambda data: {(r.x, r.y): r.part for r in evidence.spatial_split(spark.createDataFrame(data, "pair int, x double, y double, k int"), ["pair"], ["k"], 64).collect()}
    forward = split(grid)
    assert forward == split(grid[::-1]) and sum(v == "held" for v in forward.values()) == 24


@pytest.mark.parametrize("n", [5, 300, 301, 777])
def test_even_sample_positions(spark, n):
    got = evidence.even_sample(spark.range(n).selectExpr("1 as g", "id"), ["g"], ["id"], 300)
    assert [r.id for r in got.orderBy("id").collect()] == (list(range(n)) if n <= 300 else sorted({int(x) for x in np.linspace(0, n - 1, 300)}))


def test_metrics_and_gates(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 10.0)] + [(2, 0.1)] * 5, "pair int, residual_px double")
    got = {r.pair: r for r in evidence.heldout_reasons(evidence.heldout_metrics(df)).collect()}
    assert got[1].p95 == pytest.approx(8.95) and got[1].reasons == ["count", "median", "p95", "maximum"]
    assert got[2].passed and got[None].n == 9


def test_ring_corrections_recover(spark):
    c = [0, 0.10, 0.15, 0.05, -0.05, -0.10, -0.15, -0.10, 0, 0.10, 0.15, 0.10, 0, -0.05, -0.10, -0.05]
    pairs = [(7, i + 1, (i + 1) % 16 + 1, c[(i + 1) % 16] - c[i], 0.5 + i / 40) for i in range(16)]
    schema = "acq int, source_frame int, target_frame int, correction double, confidence double"
    got = registration.ring_corrections(spark.createDataFrame(pairs, schema), 4000.0).orderBy("frame").collect()
    assert [r.correction for r in got] == pytest.approx(c, abs=1e-9) and all(r.ok and r.residual_px < 1e-8 for r in got)
    assert registration.ring_corrections(spark.createDataFrame(pairs[:7] + pairs[8:], schema), 4000.0).isEmpty()
    assert registration.ring_corrections(spark.createDataFrame([(*p[:3], None, 0.0) if i == 3 else p for i, p in enumerate(pairs)], schema), 1.0).isEmpty()


def test_robust_center_drops_the_outlier(spark):
    data = [(1, 150.0, -500.0)] * 15 + [(1, 1000.0, -500.0)] + [(2, 0.0, 0.0)] * 4
    got = registration.robust_center(spark.createDataFrame(data, "acq int, center_x double, center_y double")).collect()
    assert [(r.acq, r.x, r.y, r.candidates, r.accepted) for r in got] == [(1, 150.0, -500.0, 16, 15)]


def test_pose_graph_recovers():
    rng = np.random.default_rng(0)
    angle = -np.radians(22.5) * np.arange(16) * -1
    scale, shift = np.exp(rng.normal(0, 0.002, 16)), rng.normal(0, 30, (16, 2))
    scale[0], shift[0] = 1, 0
    pose = [np.array([[s * math.cos(a), -s * math.sin(a), x], [s * math.sin(a), s * math.cos(a), y], [0, 0, 1]]) for a, s, (x, y) in zip(angle, scale, shift)]
    edges = []
    for i in range(16):
        j = (i + 1) % 16
        e = np.linalg.inv(pose[j]) @ pose[i]
        edges.append((i + 1, j + 1, -22.5, math.hypot(e[0, 0], e[1, 0]), e[0, 2], e[1, 2], 1.0))
    got = registration.pose_graph(pd.DataFrame(edges, columns=["source", "target", "angle", "scale", "tx", "ty", "weight"]))
    assert got["angle"].to_numpy() == pytest.approx(np.degrees(angle), abs=1e-8)
    assert got["scale"].to_numpy() == pytest.approx(scale, abs=1e-8)
    assert got[["tx", "ty"]].to_numpy() == pytest.approx(shift, abs=1e-6)


def test_projective_cycle_recovers():
    rng = np.random.default_rng(1)
    n, width = 5, 640.0
    poses = [np.eye(3)] + [np.eye(3) + np.array([[*rng.normal(0, 0.05, 3)], [*rng.normal(0, 0.05, 3)], [*rng.normal(0, 0.01, 2), 0]]) for _ in range(n - 1)]
    poses = [p / p[2, 2] for p in poses]
    pairs = {}
    for i in range(n):
        j = (i + 1) % n
        a = rng.uniform(0, [640, 480], (12, 2))
        pairs[i + 1, j + 1] = (a, registration.projective(np.linalg.inv(poses[j]) @ poses[i], a / width) * width)
    got = registration.projective_cycle(pairs, n, width)
    assert max(np.abs(a - b).max() for a, b in zip(got, poses)) < 1e-5


def test_flash_peaks_and_alignment(spark):
    at = [12, 46, 77, 118, 148, 190, 222, 262, 292, 329]
    scores = np.zeros(360)
    for p in at:
        scores[[p - 1, p, p + 1]] = 40, 100, 40
    assert alignment.flash_angles(scores, width=3, prominence=10) == at
    with pytest.raises(ValueError):
        alignment.flash_angles(scores, count=11, width=3, prominence=10)
    table = lambda v: spark.createDataFrame([(i, float(a)) for i, a in enumerate(sorted(v))], "place int, angle double")
    turned = [(a + 123) % 360 for a in at]
    got = alignment.best_alignment(alignment.cyclic_alignments(table(at), table(turned), 120.0, period=360.0), 120.0).first()
    assert (got.rotation, got.median_off, got.most_off) == (123.0, 0.0, 0.0)


def test_blend_and_fill(spark):
    data = [(f, x, y, f, 2 * f, 3 * f, 1) for f in range(1, 17) for x in range(4) for y in range(3)]
    got = raster.blend(spark.createDataFrame(data, "frame int, x int, y int, r int, g int, b int, w int"), ["x", "y"]).collect()
    assert {(r.r, r.g, r.b, r.coverage) for r in got} == {(8, 17, 25, 16)}
    grid = spark.range(400).selectExpr("cast(id % 20 as int) x", "cast(id / 20 as int) y")
    ring = grid.where("not (x between 7 and 12 and y between 7 and 12)").withColumn("side", F.lit("upper"))
    opened = raster.opening(ring, 20, 20, 10, 10, "side").first()
    assert opened.area == 36
    assert raster.opening(ring.where("x > 12"), 20, 20, 10, 10, "side").isEmpty()
    canvas = grid.selectExpr("x", "y", "1 r", "1 g", "1 b", "x < 10 as acquired")
    filled = raster.fill_center(canvas, grid.selectExpr("x", "y", "200 r", "100 g", "50 b"), grid.where("x >= 8"))
    assert rows(filled.groupBy("acquired", "filled", "r").count()) == [(False, True, 200, 200), (True, False, 1, 200)]


@pytest.mark.parametrize("block", [4096, 3])
def test_knn_ratio_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(evidence, "QUERY_BLOCK", block)
    rng = random.Random(2)
    v = [[rng.random() for _ in range(6)] for _ in range(120)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.query, r.neighbour) for r in evidence.ratio_matches(df, df.where("id % 10 = 0").selectExpr("id as query", "v as qv"), str(tmp_path), 0.8).collect()}
    want = set()
    for q in range(0, 120, 10):
        d = sorted((math.dist(v[q], v[i]), i) for i in range(120) if i != q)
        if d[0][0] < 0.8 * d[1][0]:
            want.add((q, d[0][1]))
    assert got == want


def test_knn_query_asks_for_every_vector(spark, tmp_path, monkeypatch):
    """Against the SQL: many blocks and slices, copies of vectors and of ids, nulls; not only ids that 50 divides are asked for."""
    from gyrelake import catalogue

    monkeypatch.setattr(evidence, "QUERY_BLOCK", 40)
    monkeypatch.setattr(evidence, "PRODUCTS", 300)
    rng = random.Random(5)
    made = [(i, [float(rng.randrange(4)) for _ in range(4)]) for i in range(150)] + [(i, [rng.random() * 9 for _ in range(4)]) for i in range(150, 260)]
    made += [(i, [1.0] * 4) for i in range(300, 340)] + [made[3], made[77], (9, [2.5] * 4), (None, [2.5] * 4), (400, None)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["knn_top2_ratio"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.ORACLE_SQL["knn_top2_ratio"]).fetchall())
    assert len(got) > 20 and sum(r[0] % 50 != 0 for r in got) > 20


def test_copies_of_a_vector_do_not_meet_pair_by_pair():
    """Of rows with one vector a few are compared, whatever id is asked for."""
    ids = np.array([5, 5, 5, 6, 7, 8, 1, 2, 2, 3])
    v = np.array([[1.0]] * 6 + [[4.0]] * 4)
    kept = evidence.different(v, ids)
    assert [(v[i, 0], ids[i]) for i in kept] == [(1, 5), (1, 5), (1, 6), (1, 7), (4, 1), (4, 2), (4, 2)]
    assert len(evidence.different(np.ones((1000, 3)), np.arange(1000))) == 3


def test_conditions_equal_numpy(spark):
    rng = random.Random(3)
    made = [[rng.uniform(-2, 2) for _ in range(9)] for _ in range(30)] + [[1.0, 2, 3, 2, 4, 6, 0, 0, 1], [0.0] * 9]
    odd = [None, [], [1.0] * 8, [1.0] * 10, [1.0] * 8 + [None], [1.0] * 8 + [float("nan")], [1.0] * 8 + [float("inf")]]
    df = spark.createDataFrame([(i, m if m is None else [None if x is None else float(x) for x in m]) for i, m in enumerate(made + odd)], "id int, m array<double>").repartition(3)
    got = {r.id: r for r in registration.conditions(df).collect()}
    for i, m in enumerate(made):
        want = np.linalg.cond(np.array(m, float).reshape(3, 3))
        assert got[i].condition == want or abs(got[i].condition / want - 1) < 1e-9 or min(got[i].condition, want) > 1e14
        assert got[i].well == (want <= 1e8)
    assert all(got[len(made) + i].condition == float("inf") and not got[len(made) + i].well for i in range(len(odd)))
