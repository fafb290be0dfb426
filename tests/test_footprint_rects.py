import random

from gyrelake.operators import projection as p


def boxes(spark, n=60):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x, y = rng.randrange(-70, 150), rng.randrange(-70, 150)
        rows.append((i % 3, f"b{i}", i % 5, rng.randrange(9) / 8, 1, x, y, x + rng.randrange(0, 140), y + rng.randrange(0, 140)))
    return spark.createDataFrame(rows, "acq int, id string, frame int, conf double, cls int, x1 int, y1 int, x2 int, y2 int"), rows


def both(spark, keys):
    frame, rows = boxes(spark)
    return p.box_rects(frame, keys), p.box_runs(frame, keys), rows


def test_overlaps_of_rectangles_and_runs(spark):
    rects, runs, rows = both(spark, ["acq", "id"])
    want = []
    for a in rows:
        for b in rows:
            w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
            if a[0] == b[0] and a[1] < b[1] and w > 0 and h > 0:
                want.append((a[0], a[1], b[1], w * h))
    for form in (rects, runs):
        assert sorted(map(tuple, p.footprint_overlaps(form, ["acq"], "id").collect())) == sorted(want)
    assert rects.selectExpr("max(size(rects))").first()[0] == 1


def test_clip_of_rectangles_and_runs(spark):
    rects, runs, _ = both(spark, ["acq", "id"])
    seen = spark.range(100 * 100).selectExpr("cast(id % 3 as int) as acq", "cast(id % 100 as int) as x", "cast(id div 100 as int) as y", "cast(id % 7 < 5 as int) as p")
    for within in ([], ["acq"]):
        clips = [sorted(map(tuple, p.clip_to_acquired(f, seen, ["acq", "id"], within).collect())) for f in (rects, runs)]
        assert clips[0] == clips[1] and clips[0]


def test_equal_shapes_are_clipped_once(spark):
    """The plan clips distinct shapes; each footprint that has one takes its result."""
    frame = spark.createDataFrame([(i, 1, 1, 5, 4) for i in range(50)], "id int, x1 int, y1 int, x2 int, y2 int")
    seen = spark.createDataFrame([(x, y, 1) for x in range(3) for y in range(9)], "x int, y int, p int")
    out = p.clip_to_acquired(p.box_rects(frame, ["id"]), seen, ["id"])
    assert sorted(map(tuple, out.collect())) == [(i, 1, 1, 3, 4, 6) for i in range(50)]


def test_dedup_of_rectangles_and_runs(spark):
    rects, runs, _ = both(spark, ["acq", "frame", "id", "conf", "cls"])
    got = [sorted(map(str, p.dedup_footprints(f, ["acq"], 0.4).collect())) for f in (rects, runs)]
    assert got[0] == got[1] and 3 < len(got[0]) < 60
