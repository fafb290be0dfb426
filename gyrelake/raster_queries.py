"""Queries over rasters: warps, masks, polygons and what is made of them, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyrelake.operators import polygons, raster, slicing, warp
from gyrelake.registry import query
from gyrelake.sources.testdata import adapted, sql

#: Sources of 64 x 48 pixels in small blocks, a canvas of 80 x 64 in small tiles: many of both in each image.
SOURCE, CANVAS, BLOCK, TILE = (64, 48), (80, 64), 16, 32
#: Output to source for each frame; all cells are short binary fractions, so that both engines compute exactly.
CELLS = ("1e0", "frame / 16e0", "-8e0", "frame / -16e0", "1e0", "4e0")
MATRIX = f"array({', '.join(CELLS)}, 0e0, 0e0, 1e0)"
BANDS = ["r", "g", "b"]


def plates(spark, sf_dir):
    return adapted(spark, sf_dir, "plates")


def canvases(pixels):
    """The canvas of each acquisition and frame in tiles."""
    each = pixels.select("acq", "frame").distinct().selectExpr("acq", "frame", f"{MATRIX} as m", f"{SOURCE[0]} as width", f"{SOURCE[1]} as height")
    return warp.stretches(each, F.lit(0), F.lit(0), F.lit(CANVAS[0]), F.lit(CANVAS[1]), TILE)


def _points() -> str:
    """Every canvas pixel of every frame whose center maps into the source, and the point that it maps to."""
    u, v = (f"{a} * (x + 0.5e0) + {b} * (y + 0.5e0) + {c}" for a, b, c in (CELLS[:3], CELLS[3:]))
    return f"""
        p as materialized (select acq, frame, x, y, max(r) as r, max(g) as g, max(b) as b, max(mask) as mask from {sql("plates")} group by all),
        o as (select acq, frame, cast(i as integer) as x, cast(j as integer) as y from (select distinct acq, frame from p), (select range as i from range({CANVAS[0]})), (select range as j from range({CANVAS[1]}))),
        s as (select * from (select *, {u} as u, {v} as v from o) where u >= 0 and u < {SOURCE[0]} and v >= 0 and v < {SOURCE[1]})"""


def _taps(kernel: str, reach: range, bands: list[str]) -> str:
    """Sums over the taps of a kernel, given as an expression of the distance @, cut to 0..255."""
    sums = ", ".join(f"cast(least(255, greatest(0, floor(sum(wx * wy * coalesce(p.{c}, 0)) + 1e-9))) as integer) as {c}" for c in bands)
    weight = lambda d: kernel.replace("@", f"abs({d})")
    return f"""
        select t.acq, t.frame, t.x, t.y, {sums} from (
            select *, {weight("u - 0.5e0 - tx")} as wx, {weight("v - 0.5e0 - ty")} as wy, cast(least(greatest(tx, 0), {SOURCE[0] - 1}) as integer) as sx, cast(least(greatest(ty, 0), {SOURCE[1] - 1}) as integer) as sy
            from (select *, floor(u - 0.5e0) + i as tx, floor(v - 0.5e0) + j as ty from s, (select unnest({list(reach)}) as i), (select unnest({list(reach)}) as j))
        ) t left join p on p.acq = t.acq and p.frame = t.frame and p.x = t.sx and p.y = t.sy group by t.acq, t.frame, t.x, t.y"""


#: Weights at a distance of @ pixels: the straight line, and cubic convolution with a = -1.
LINEAR = "(1 - @)"
CUBIC = "(case when @ <= 1 then @ * @ * @ - 2 * @ * @ + 1 when @ < 2 then 5 * @ * @ - @ * @ * @ - 8 * @ + 4 else 0 end)"

WARPED_SQL = f"""
    with {_points()},
    v as ({_taps(LINEAR, range(2), BANDS)}),
    f as (select acq, frame, x, y, {CELLS[0]} * x + {CELLS[1]} * y + {CELLS[2]} as u, {CELLS[3]} * x + {CELLS[4]} * y + {CELLS[5]} as v from s),
    w as (select acq, frame, x, y, greatest(0, least(u + 1, {SOURCE[0]} - u, v + 1, {SOURCE[1]} - v, 512)) as w from f)
    select acq, x, y, cast(floor(sum(w * r) / sum(w)) as integer) as r, cast(floor(sum(w * g) / sum(w)) as integer) as g, cast(floor(sum(w * b) / sum(w)) as integer) as b, cast(least(count(*), 255) as integer) as coverage
    from v join w using (acq, frame, x, y) where w > 0 group by acq, x, y
"""


@query(WARPED_SQL)
def tile_warp_blend(spark, sf_dir):
    """Frames warped to their acquisition's canvas (bilinear), weighted by feathers and blended."""
    pixels = plates(spark, sf_dir)
    blocks = warp.raster_blocks(pixels, ["acq", "frame"], BANDS, BLOCK)
    tiles = warp.warp_tiles(canvases(pixels), blocks, ["acq", "frame"], [], ["bilinear"] * 3, BLOCK)
    return raster.blend(warp.tile_pixels(tiles, ["acq"], BANDS), ["acq", "x", "y"]).select("acq", "x", "y", *BANDS, "coverage")


def reference_layer(pixels):
    """Colours (bicubic) and mask (bilinear) of every frame on the canvas."""
    blocks = warp.raster_blocks(pixels, ["acq", "frame"], [*BANDS, "mask"], BLOCK)
    tiles = warp.warp_tiles(canvases(pixels), blocks, ["acq", "frame"], [], ["bicubic"] * 3 + ["bilinear"], BLOCK)
    return warp.tile_pixels(tiles, ["acq", "frame"], [*BANDS, "mask"])


REFERENCE_SQL = f"with {_points()}, c as ({_taps(CUBIC, range(-1, 3), BANDS)}), k as ({_taps(LINEAR, range(2), ['mask'])})"


@query(f"{REFERENCE_SQL} select acq, frame, x, y, r, g, b, mask >= 128 as known from c join k using (acq, frame, x, y)")
def reference_warp(spark, sf_dir):
    return reference_layer(plates(spark, sf_dir)).select("acq", "frame", "x", "y", *BANDS, (F.col("mask") >= 128).alias("known"))


@query(f"""
    {REFERENCE_SQL},
    seen as (select acq, x, y, count(*) as n from s where frame > 0 and (x * 7 + y * 3) % 5 > 0 group by acq, x, y),
    ref as (select acq, x, y, r, g, b from c join k using (acq, frame, x, y) where frame = 0 and mask >= 128),
    grid as (select acq, cast(i as integer) as x, cast(j as integer) as y from (select distinct acq from p), (select range as i from range({CANVAS[0]})), (select range as j from range({CANVAS[1]})))
    select acq, case when n > 0 then 1 when r is not null then 2 else 0 end as provenance, count(*) as pixels, cast(sum(coalesce(n, 0)) as bigint) as coverage,
        cast(sum(case when n is null then coalesce(r, 0) + coalesce(g, 0) * 3 + coalesce(b, 0) * 5 else 0 end) as bigint) as filled
    from grid left join seen using (acq, x, y) left join ref using (acq, x, y) group by acq, provenance
""")
def reference_fill(spark, sf_dir):
    """What the reference layer (frame 0) fills where the other frames left gaps, by provenance."""
    pixels = plates(spark, sf_dir)
    seen, known = F.expr("frame > 0 and (x * 7 + y * 3) % 5 > 0"), F.expr("frame = 0 and mask >= 128")
    both = reference_layer(pixels).where(seen | known).groupBy("acq", "x", "y")  # the layer is warped once
    both = both.agg(F.least(F.count_if(seen), F.lit(255)).alias("coverage"), F.count_if(known).alias("known"), *[F.max(F.when(known, F.col(b))).alias(b) for b in BANDS])
    grid = pixels.select("acq").distinct().select("acq", F.explode(F.sequence(F.lit(0), F.lit(CANVAS[0] - 1))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(CANVAS[1] - 1))))
    kinds = grid.join(both, ["acq", "x", "y"], "left").withColumns({"coverage": F.coalesce("coverage", F.lit(0)), "provenance": raster.kind(F.coalesce("coverage", F.lit(0)), F.col("known") > 0)})
    worth = F.coalesce("r", F.lit(0)) + F.coalesce("g", F.lit(0)) * 3 + F.coalesce("b", F.lit(0)) * 5
    filled = F.sum(F.when(F.col("coverage") == 0, worth).otherwise(0)).cast("long").alias("filled")
    return kinds.groupBy("acq", "provenance").agg(F.count("*").alias("pixels"), F.sum("coverage").cast("long").alias("coverage"), filled)


#: Source to canvas of each mask: a shift, a quarter turn, twice the size, a quarter turn back at twice the size.
MASK_CELLS = [f"case id % 4 when 0 then {a}e0 when 1 then {b}e0 when 2 then {c}e0 else {d}e0 end" for a, b, c, d in ((1, 0, 2, 0), (0, -1, 0, 2), (5, 60, -10, 4), (0, 1, 0, -2), (1, 0, 2, 0), (3, 2, 1, 70))]
MASK_SIZE, MASK_CANVAS, MOST = (24, 16), (96, 80), 4_194_304


def footprints(spark, sf_dir):
    """Masks of 24 x 16 pixels, each at its own place in its frame, warped to the canvas."""
    pixels = adapted(spark, sf_dir, "masks").withColumn("v", F.lit(255))
    blocks = warp.raster_blocks(pixels, ["acq", "id"], ["v"], 8)
    masks = pixels.select("acq", "id").distinct().selectExpr("acq", "id", "id * 3 as x", "id * 2 as y", f"{MASK_SIZE[0]} as width", f"{MASK_SIZE[1]} as height", f"array({', '.join(MASK_CELLS)}, 0e0, 0e0, 1e0) as m")
    return warp.warp_masks(warp.mask_bounds(masks, MASK_CANVAS, MOST), blocks, ["acq", "id"], 8, TILE)


@query(f"""
    with p as (select distinct acq, id, x, y from {sql("masks")}),
    m as (select acq, id, {", ".join(f"{c} as m{k}" for k, c in enumerate(MASK_CELLS))} from (select distinct acq, id from p)),
    g as (select *, i + 0.5e0 - m2 as dx, j + 0.5e0 - m5 as dy, m0 * m4 - m1 * m3 as det from m, (select range as i from range({MASK_CANVAS[0]})), (select range as j from range({MASK_CANVAS[1]}))),
    c as (select acq, id, i, j, floor((m4 * dx - m1 * dy) / det - id * 3) as x, floor((m0 * dy - m3 * dx) / det - id * 2) as y from g),
    h as (select c.acq, c.id, c.i, c.j, c.i - row_number() over (partition by c.acq, c.id, c.j order by c.i) as run from c join p on p.acq = c.acq and p.id = c.id and p.x = c.x and p.y = c.y)
    select acq, id, cast(j as integer) as y, cast(min(i) as integer) as x1, cast(max(i) + 1 as integer) as x2 from h group by acq, id, j, run
""")
def mask_footprints(spark, sf_dir):
    return footprints(spark, sf_dir).select("acq", "id", F.inline("runs"))


#: A lozenge in each box of det_acq, shifted so that some leave the canvas.
CORNERS = [("(x1 + x2) / 2e0 - 6", "y1 - 3"), ("x2 - 6", "(y1 + y2) / 2e0 - 3"), ("(x1 + x2) / 2e0 - 6", "y2 - 3"), ("x1 - 6", "(y1 + y2) / 2e0 - 3")]
DET_KEY = "acq, cls, conf, slice_index, x1, y1, x2, y2"


@query(f"""
    with b as (select {DET_KEY}, {", ".join(f"{x} as px{i}, {y} as py{i}" for i, (x, y) in enumerate(CORNERS))} from {sql("det_acq")}),
    w as (select *, greatest(0, floor(px3)) as l, greatest(0, floor(py0)) as t, least(80, ceil(px1)) as r, least(60, ceil(py2)) as e from b),
    k as (select {DET_KEY}, l, t, r, e, {", ".join(f"trunc(px{i} - l) + l as cx{i}, trunc(py{i} - t) + t as cy{i}" for i in range(4))} from w where l < r and t < e),
    d as (select *, unnest([{", ".join(f"struct_pack(ax := cx{i}, ay := cy{i}, bx := cx{(i + 1) % 4}, by := cy{(i + 1) % 4})" for i in range(4))}]) as g from k),
    y as (select *, unnest(range(cast(t as bigint), cast(e as bigint))) as y from d),
    x as (
        select {DET_KEY}, y, l, r, case when g.ay = g.by then least(g.ax, g.bx) else (y - g.ay) * ((g.bx - g.ax) / (g.by - g.ay)) + g.ax end as lo, case when g.ay = g.by then greatest(g.ax, g.bx) else (y - g.ay) * ((g.bx - g.ax) / (g.by - g.ay)) + g.ax end as hi
        from y where y between least(g.ay, g.by) and greatest(g.ay, g.by)
    ),
    u as (select {DET_KEY}, y, greatest(floor(min(lo) + 0.5e0), any_value(l)) as x1_, least(ceil(max(hi) - 0.5e0) + 1, any_value(r)) as x2_ from x group by {DET_KEY}, y)
    select {DET_KEY}, count(*) as lines, cast(min(y) as integer) as top, cast(max(y) + 1 as integer) as bottom, cast(min(x1_) as integer) as left_px, cast(max(x2_) as integer) as right_px, cast(sum(x2_ - x1_) as bigint) as area
    from u where x1_ < x2_ group by {DET_KEY}
""")
def polygon_footprints(spark, sf_dir):
    keys = DET_KEY.split(", ")
    box = ["x1", "y1", "x2", "y2"]
    rows = adapted(spark, sf_dir, "det_acq").distinct()
    shapes = rows.select(*box).distinct().withColumn("corners", F.array(*[F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in CORNERS]))
    runs = polygons.polygon_runs(shapes, box, (80, 60))  # equal boxes have one polygon, which is filled once
    cells = {n: F.col(f"runs.{n}") for n in ("x1", "x2", "y")}
    area = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["x2"] - r["x1"])
    found = runs.select(*box, F.size(F.array_distinct(cells["y"])).cast("long").alias("lines"), F.array_min(cells["y"]).alias("top"), (F.array_max(cells["y"]) + 1).alias("bottom"), F.array_min(cells["x1"]).alias("left_px"), F.array_max(cells["x2"]).alias("right_px"), area.alias("area"))
    return rows.join(found, box).select(*keys, "lines", "top", "bottom", "left_px", "right_px", "area")


#: Windows of 24 pixels every 12, four in a batch, over frames of 50 x 40: the last ones end at the far edges.
WINDOW, STEP, BATCH, FRAME = 24, 12, 4, (50, 40)


def _places(side: int) -> list[int]:
    return [*range(0, side - WINDOW + 1, STEP), *([side - WINDOW] if (side - WINDOW) % STEP else [])]


@query(f"""
    with p as (select acq * 4 + frame as frame, x, y, max(r) as r, max(g) as g, max(b) as b from {sql("plates")} where x < {FRAME[0]} and y < {FRAME[1]} group by all),
    w as (select row_number() over (order by y0, x0) - 1 as n, x0, y0 from (select unnest({_places(FRAME[0])}) as x0), (select unnest({_places(FRAME[1])}) as y0)),
    c as (select f.frame, n, x0 + i as x, y0 + j as y, k, (k * {WINDOW} + j) * {WINDOW} + i as place from (select distinct frame from p) f, w, (select range as i from range({WINDOW})), (select range as j from range({WINDOW})), (select range as k from range(3))),
    v as (select c.frame, n, place, coalesce(case k when 0 then r when 1 then g else b end, 0) as v from c left join p on p.frame = c.frame and p.x = c.x and p.y = c.y)
    select frame, cast(n // {BATCH} as integer) as batch_index, cast(count(distinct n) as integer) as windows, sha256(unhex(string_agg(printf('%02x', v), '' order by n, place))) as sha256 from v group by frame, n // {BATCH}
""")
def window_batches(spark, sf_dir):
    """Overlapping windows of every frame as binary tensors of four, told by their hashes."""
    pixels = plates(spark, sf_dir).where(f"x < {FRAME[0]} and y < {FRAME[1]}").withColumn("frame", F.expr("acq * 4 + frame"))
    frames = pixels.select("frame").distinct().selectExpr("frame", f"{FRAME[0]} as width", f"{FRAME[1]} as height")
    out = slicing.pixel_batches(slicing.slice_windows(frames, WINDOW, STEP), warp.raster_blocks(pixels, ["frame"], BANDS, BLOCK), 3, BATCH, WINDOW, BLOCK)
    return out.select("frame", "batch_index", "windows", F.sha2("tensor", 256).alias("sha256"))
