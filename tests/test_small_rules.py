"""Small rules of files, rasters, predictions and tables, each against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from gyrelake.functions import geometry as G
from gyrelake.functions import text as X
from gyrelake.operators import projection, raster, slicing
from gyrelake.plans import metadata
from gyrelake.sources import files


def test_names_of_files(spark):
    kinds = spark.createDataFrame([("JPEG",), ("PNG",), ("TIFF",), ("GIF",), (None,)], "k string")
    assert [r[0] for r in kinds.select(X.canonical_extension(F.col("k"))).collect()] == [".jpg", ".png", ".tif", None, None]
    paths = {"/data/a": True, "/data/b/c": True, "/data": False, "/database/a": False, "/data/../etc": False, "/data/a/..": False, "/data/a..b": True}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", X.contained_in(F.lit("/data/"), F.col("p"))).collect()
    assert dict(map(tuple, got)) == paths


def test_trees_of_files(spark):
    tree = spark.createDataFrame([("s", "a/One.png", 5), ("s", "a/one.PNG", 7), ("s", "b", 11), ("t", "z", 2)], "source string, relative string, length long")
    assert [tuple(r) for r in files.colliding(tree).collect()] == [("a/one.png", 2)]
    assert files.over_limits(tree, 4, 25).isEmpty() and [tuple(r) for r in files.over_limits(tree, 3, 25).collect()] == [(4, 25)]
    assert files.over_limits(tree.limit(0), 0, 0).isEmpty()
    got = files.running_limit(tree, "source").orderBy("source", "relative").select("count_so_far", "bytes_so_far").collect()
    assert [tuple(r) for r in got] == [(1, 5), (2, 12), (3, 23), (1, 2)]


def test_required_fields_of_json(spark, tmp_path):
    for name, body in {"whole": {"a": 1, "b": "x"}, "short": {"a": 1}, "typed": {"a": "one", "b": "x"}, "more": {"a": 1, "b": "x", "c": 2}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    got = files.documents(spark, str(tmp_path), "a int, b string", required=("a", "b")).collect()
    assert {r.path.rsplit("/", 1)[1]: r.problem for r in got} == {"whole.json": None, "short.json": "missing", "typed.json": "missing", "more.json": "extra"}


def test_scales_and_sizes(spark):
    one = spark.range(1)
    got = one.select(G.preview_scale(F.lit(4000), F.lit(1000), 1000), G.preview_scale(F.lit(40), F.lit(10), 1000), G.disk_estimate(F.lit(10), F.lit(10)), G.edge_weight(F.lit(25), F.lit(2.0)), G.edge_weight(F.lit(500), F.lit(0.1)), G.edge_weight(F.lit(0), F.lit(1.0))).first()
    assert tuple(got) == pytest.approx((0.25, 1.0, 600 + (16 << 20), 0.125, 4.0, 1e-6))


def test_pixels(spark):
    p = spark.createDataFrame([(0, 0, 255, 0, 0, 0), (10, 0, 10, 20, 30, 2), (0, 20, 0, 0, 0, 1)], "x int, y int, r int, g int, b int, coverage int")
    got = p.select(raster.grey(F.col("r"), F.col("g"), F.col("b")), raster.saturation(F.col("r"), F.col("g"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(76, 255), (18, 170), (0, 0)]
    assert tuple(raster.coverage_report(p).first()) == (1, 2)
    assert raster.surface(p, 40, 0.5).count() == 1
    assert [(r.x, r.y, r.bin) for r in raster.annulus(p, 0.0, 0.0, 10.0).collect()] == [(10, 0, 0)]
    assert [tuple(r) for r in raster.canvas_geometry(spark.createDataFrame([(1, -0.5, 2.0), (1, 9.2, 7.7)], "acq int, x double, y double"), "acq").collect()] == [(1, -1, 2, 12, 7)]
    m = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -0.1, 0.0, 1.0)])
    assert [r[0] for r in p.select(raster.beyond_horizon(m, F.col("x"), F.col("y"))).collect()] == [False, True, False]
    assert raster.unknown_provenance(spark.createDataFrame([(0,), (3,), (4,), (None,)], "p int")).count() == 2


def test_predictions_at_the_edge(spark):
    d = spark.createDataFrame([(0, 1.0, 2.0, 5.5, 6.5), (0, -9.0, -9.0, -3.0, -3.0), (1, 10.0, 0.0, 12.0, 1.0)], "frame int, x1 double, y1 double, x2 double, y2 double")
    m = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -0.1, 0.0, 1.0])], "frame int, m array<double>")
    got = projection.project_corners(d.where("frame = 0"), m).select(projection.clipped_bounds(F.col("corners"), F.lit(4), F.lit(9)).alias("b")).collect()
    assert sorted((r.b and tuple(r.b) for r in got), key=str) == [(1, 2, 4, 7), None]
    bounds = projection.projected_bounds(d, m).orderBy("frame", "x1").select("left_px", "top_px", "right_px", "bottom_px").collect()
    assert [tuple(r) for r in bounds] == [(-9.0, -9.0, -3.0, -3.0), (1.0, 2.0, 5.5, 6.5), (None,) * 4]
    channels = slicing.preprocess([F.lit(10), F.lit(20), F.lit(30)], "BGR", 0.1, [1.0, 0.0, 0.0], [2.0, 1.0, 1.0])
    assert tuple(spark.range(1).select(*channels).first()) == pytest.approx((1.0, 2.0, 1.0))


def test_rows_that_depend_on_others(spark):
    children = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, parent string")
    assert [r.id for r in metadata.cascade(children, spark.createDataFrame([("a",)], "key string"), "parent", "key").collect()] == [1]
    stages = spark.createDataFrame([("fine", 1, 2, "done", None), ("late", 2, 1, "done", None), ("odd", 1, 2, "failed", None), ("mute", 1, 2, "done", "e"), ("open", 1, None, "running", None)], "stage string, started_at int, finished_at int, status string, error string")
    assert sorted(r.stage for r in metadata.stages_ok(stages).collect()) == ["late", "mute", "odd"]


def test_grid_cull_equals_the_join_and_moves_no_tiles(spark):
    import random

    from gyrelake.operators import raster

    rng = random.Random(4)
    boxes = [(rng.randrange(3), rng.randrange(4), x, y, x + rng.randrange(-3, 9), y + rng.randrange(9)) for x, y in ((rng.randrange(-8, 24), rng.randrange(-8, 24)) for _ in range(300))]
    boxes += boxes[:40] + [(0, 1, None, 2, 5, 5), (1, 2, 4, 4, 4, 4), (2, 3, 0, 4, 8, 8)]
    bounds = spark.createDataFrame(boxes, "acq long, frame long, left long, top long, right long, bottom long")
    tiles = spark.createDataFrame([(a, r * 5 + c, c * 4, r * 4, c * 4 + 4, r * 4 + 4) for a in range(3) for r in range(4) for c in range(5)], "acq long, tile long, x0 long, y0 long, x1 long, y1 long")
    want = raster.cull(tiles, bounds.distinct()).groupBy("acq", "tile", "frame").count()
    got = raster.grid_cull(bounds, 5, 4, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1 and plan.count("Repartition") == 1
