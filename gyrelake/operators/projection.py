"""Predictions on the common canvas: projection, acquired-pixel clip, budgets and de-duplication."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gyrelake.functions.geometry import map_point
from gyrelake.operators.grouping import sorted_groups

ACQUIRED = 1


def project_corners(predictions: DataFrame, frames: DataFrame) -> DataFrame:
    """predictions (frame, x1..y2) with ``corners``: the four corners through their frame's matrix ``m``."""
    joined = predictions.join(frames.select("frame", "m"), "frame")
    corner = [(F.col(a), F.col(b)) for a, b in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]
    return joined.withColumn("corners", F.array(*[map_point(F.col("m"), x, y) for x, y in corner])).drop("m")


def unplaced(predictions: DataFrame, frames: DataFrame) -> DataFrame:
    """Predictions that cannot be projected, with ``problem``: no matrix for their ``frame``, or a corner at ``infinity``; a projection is whole only when there are none."""
    joined = projected_bounds(predictions, frames, "left")
    problem = F.when(F.col("known__").isNull(), "frame").when(F.col("left_px").isNull(), "infinity")
    return joined.withColumn("problem", problem).where("problem is not null").select(*predictions.columns, "problem")


def projected_bounds(predictions: DataFrame, frames: DataFrame, how: str = "inner", gate: float = 1e-12) -> DataFrame:
    """predictions with left_px, top_px, right_px, bottom_px around their corners through the frame's matrix ``m``.

    All four are null where a corner goes to infinity: such a prediction is to be rejected, not cut (``unplaced``).
    """
    numbers = {f"n__{k}": F.col("m")[k].cast("double") for k in range(9)} | {f"n__{c}": F.col(c).cast("double") for c in BOX}
    out = predictions.join(frames.select("frame", "m", F.lit(True).alias("known__")), "frame", how).withColumns(numbers)
    names = [*predictions.columns, *(["known__"] if how == "left" else [])]
    edges, read = ["left_px", "top_px", "right_px", "bottom_px"], list(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, none = corner_bounds([batch[c] for c in read], gate)
            yield pa.record_batch([*[batch[c] for c in names], *[pa.array(v, pa.float64(), mask=none) for v in found]], [*names, *edges])

    plain = StructType([StructField(f.name, f.dataType) for f in out.select(names).schema] + [StructField(e, DoubleType()) for e in edges])
    return out.select(*names, *numbers).mapInArrow(run, plain)


BOX = ("x1", "y1", "x2", "y2")


def corner_bounds(columns: list[pa.Array], gate: float) -> tuple[list[np.ndarray], np.ndarray]:
    """([left, top, right, bottom], where they are null) of a batch's nine matrix cells and four box edges.

    A corner with a null number is left out; a NaN is greater than any number, as in Spark's least and greatest.
    """
    values = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
    null = [c.is_null().to_numpy(zero_copy_only=False) for c in columns]
    m, lost = values[:9], np.logical_or.reduce(null[:9])
    corners = [(9, 10), (11, 10), (11, 12), (9, 12)]
    gone = [lost | null[a] | null[b] for a, b in corners]
    with np.errstate(all="ignore"):
        w = [m[6] * values[a] + m[7] * values[b] + m[8] for a, b in corners]
        low = np.fmin.reduce([np.where(g, np.inf, np.abs(v)) for g, v in zip(gone, w, strict=True)])
        none = np.logical_and.reduce(gone) | (low <= gate)
        xs, ys = ([(m[k] * values[a] + m[k + 1] * values[b] + m[k + 2]) / v for (a, b), v in zip(corners, w, strict=True)] for k in (0, 3))
        least = [np.fmin.reduce([np.where(g, np.inf, v) for g, v in zip(gone, s, strict=True)]) for s in (xs, ys)]
        most = [np.maximum.reduce([np.where(g, -np.inf, v) for g, v in zip(gone, s, strict=True)]) for s in (xs, ys)]
    return [*least, *most], none


def clipped_bounds(corners: Column, width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom) of whole pixels around the corners inside the canvas; null when empty."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    left, top = F.greatest(F.lit(0), F.floor(F.array_min(xs))).cast("int"), F.greatest(F.lit(0), F.floor(F.array_min(ys))).cast("int")
    right, bottom = F.least(width, F.ceil(F.array_max(xs))).cast("int"), F.least(height, F.ceil(F.array_max(ys))).cast("int")
    box = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    return F.when((left < right) & (top < bottom), box)


def box_runs(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """A footprint for each box with whole-number bounds x1, y1, x2, y2 (ends exclusive): ``runs``, a (y, x1, x2) for each line.

    A footprint is any set of disjoint runs; it grows with its height, not its area. Empty boxes and
    null bounds give no row.
    """
    down = F.sequence(F.col("y1").cast("int"), F.col("y2").cast("int") - 1)
    line = lambda y: F.struct(y.alias("y"), F.col("x1").cast("int").alias("x1"), F.col("x2").cast("int").alias("x2"))
    return boxes.where("x2 > x1 and y2 > y1").select(*keys, F.transform(down, line).alias("runs"))


def box_rects(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``box_runs`` in less room: ``rects``, one (y1, y2, x1, x2) for each box, whatever its height is.

    What takes footprints takes either form; the rectangles of a footprint are disjoint as well.
    """
    cell = F.struct(*[F.col(c).cast("int").alias(c) for c in ("y1", "y2", "x1", "x2")])
    return boxes.where("x2 > x1 and y2 > y1").where("cast(x2 as int) > cast(x1 as int) and cast(y2 as int) > cast(y1 as int)").select(*keys, F.array(cell).alias("rects"))


def rects(footprints: DataFrame, keys: list[str]) -> DataFrame:
    """A row (y1, y2, x1, x2) for each rectangle; a run is one of a line."""
    if "rects" in footprints.columns:
        return footprints.select(*keys, F.inline("rects"))
    return footprints.select(*keys, F.inline("runs")).select(*keys, F.col("y").alias("y1"), (F.col("y") + 1).alias("y2"), "x1", "x2")


def lines(footprints: DataFrame, keys: list[str]) -> DataFrame:
    """A row (y, x1, x2) for each run."""
    if "rects" in footprints.columns:
        return rects(footprints, keys).select(*keys, F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"), "x1", "x2")
    return footprints.select(*keys, F.inline("runs"))


def acquired_runs(provenance: DataFrame, within: list[str] = []) -> DataFrame:  # noqa: B006
    """(y, left, right): the longest runs of acquired pixels on each line of a map (x, y, p); ends exclusive."""
    line = Window.partitionBy(*within, "y").orderBy("x")
    seen = provenance.where(F.col("p") == ACQUIRED).select(*within, "x", "y").distinct()
    runs = seen.withColumn("run", F.col("x") - F.row_number().over(line)).groupBy(*within, "y", "run")
    return runs.agg(F.min("x").alias("left"), (F.max("x") + 1).alias("right")).drop("run")


#: Runs are cut at multiples of this many pixels before they are joined, so that a line's key is not the whole line.
STRIP = 64


def strips(runs: DataFrame, left: str, right: str) -> DataFrame:
    """Runs cut at strip borders, with the strip that each part lies in."""
    each = F.explode(F.sequence(F.floor(F.col(left) / STRIP), F.floor((F.col(right) - 1) / STRIP)))
    cut = runs.where(F.col(left) < F.col(right)).withColumn("strip", each)
    return cut.withColumns({left: F.greatest(F.col(left), F.col("strip") * STRIP).cast("int"), right: F.least(F.col(right), (F.col("strip") + 1) * STRIP).cast("int")})


def clip_to_acquired(footprints: DataFrame, provenance: DataFrame, keys: list[str], within: list[str] = []) -> DataFrame:  # noqa: B006
    """The trimmed extent and area of what lies on acquired pixels; predictions without any are gone.

    ``within`` names the columns of both tables that tell the canvases of several acquisitions apart. Each different shape of a
    canvas is clipped once, and the footprints that have it take the result. Lines meet strip by strip; the acquired pixels of a strip are
    one row, so that a task holds one of them. The map of a single canvas is sent to all tasks.
    """
    form = "rects" if "rects" in footprints.columns else "runs"
    shape = [*within, form]
    strip = strips(acquired_runs(provenance, within), "left", "right").groupBy(*within, "y", "strip").agg(F.collect_list(F.struct("left", "right")).alias("seen"))  # STRIP / 2 runs at most
    shapes = footprints.select(*shape).distinct().withColumn("shape__", F.col(form))
    runs = strips(lines(shapes, [*within, "shape__"]), "x1", "x2")
    met = runs.join(strip if within else F.broadcast(strip), [*within, "y", "strip"])
    seen = met.select(*within, "shape__", "y", "x1", "x2", F.inline("seen")).where("x1 < right and left < x2")
    cut = seen.withColumns({"x1": F.greatest("x1", "left"), "x2": F.least("x2", "right")})
    extent = [F.min("x1").alias("x1__"), F.min("y").alias("y1__"), F.max("x2").alias("x2__"), (F.max("y") + 1).alias("y2__"), F.sum(F.col("x2") - F.col("x1")).alias("area__")]
    found = cut.groupBy(*within, "shape__").agg(*extent).withColumnRenamed("shape__", form)
    named = footprints.select(*dict.fromkeys([*within, *keys]), form).join(found, shape)
    return named.groupBy(*keys).agg(F.min("x1__").alias("x1"), F.min("y1__").alias("y1"), F.max("x2__").alias("x2"), F.max("y2__").alias("y2"), F.sum("area__").alias("area"))


def footprint_overlaps(footprints: DataFrame, within: list[str], key: str) -> DataFrame:
    """a, b and both: common pixels of two footprints of a group, by an equi-join on square cells of ``STRIP`` pixels.

    Rectangles are cut at the cells' borders, so that each common pixel counts in one cell; a box moves as a few rows, not one for each line.
    """
    parts = rects(footprints, [*within, key])
    for side in "yx":
        lo, hi, cell = F.col(f"{side}1"), F.col(f"{side}2"), F.col(f"{side}__")
        parts = parts.where(lo < hi).withColumn(f"{side}__", F.explode(F.sequence(F.floor(lo / STRIP), F.floor((hi - 1) / STRIP))))
        parts = parts.withColumns({f"{side}1": F.greatest(lo, cell * STRIP).cast("int"), f"{side}2": F.least(hi, (cell + 1) * STRIP).cast("int")})
    cells = [*within, F.col("y__").cast("int").alias("y__"), F.col("x__").cast("int").alias("x__")]
    left, right = (parts.select(*cells, F.col(key).alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("x1", "x2", "y1", "y2")]) for n in "ab")
    meet = left.join(right, [*within, "y__", "x__"]).where("a < b and a_x1 < b_x2 and b_x1 < a_x2 and a_y1 < b_y2 and b_y1 < a_y2")
    wide, high = (F.least(f"a_{s}2", f"b_{s}2") - F.greatest(f"a_{s}1", f"b_{s}1") for s in "xy")
    return meet.groupBy(*within, "a", "b").agg(F.sum(wide * high).alias("both"))


def running_budget(sizes: DataFrame, group: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """Sizes with their running total in order, and whether it is within the bound."""
    total = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("total", total).withColumn("within", F.col("total") <= most)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull, counter-clockwise from the least point, without collinear points."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(rows: list) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def stable_id(cls: int, links: list[tuple[int, str]]) -> str:
    text = "|".join([str(cls), *(f"{f}:{i}" for f, i in links)])
    return "disc-prediction-" + hashlib.sha256(text.encode()).hexdigest()[:24]


def dedup_footprints(footprints: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Greedy de-duplication of footprints (frame, id, conf, cls and runs or rects) in each group.

    Best first: by confidence, then box, then id; a footprint absorbs those that overlap its present
    union at ``threshold`` (max of IoU and share of the smaller), until a pass changes nothing. The
    result keeps the greatest confidence, the union, all links sorted, and an id made from them.
    A task holds the footprints of one group, a bit for each pixel of the group's extent.
    """

    def work(key: tuple, rows: list[tuple]) -> list[tuple]:
        if len(rows) == 1:  # nothing to compare
            frame, name, conf, cls, flat = rows[0]
            tops, bottoms, lefts, rights = (flat[i::4] for i in range(4))
            area = sum((b - t) * (r - l) for t, b, l, r in zip(tops, bottoms, lefts, rights, strict=True))
            return [(*key, min(lefts), min(tops), max(rights), max(bottoms), conf, area, stable_id(cls, [(frame, name)]), [f"{frame}:{name}"])]
        top, left, right = (f(f(r[4][i::4]) for r in rows) for f, i in ((min, 0), (min, 2), (max, 3)))
        stride, items, ones = right - left, [], {1: 1}
        for frame, name, conf, cls, flat in rows:
            bits = 0
            for y1, y2, x1, x2 in zip(flat[::4], flat[1::4], flat[2::4], flat[3::4], strict=True):
                if (high := y2 - y1) not in ones:
                    ones[high] = ((1 << high * stride) - 1) // ((1 << stride) - 1)  # a bit at the begin of each line
                bits |= ones[high] * ((1 << x2 - x1) - 1) << (y1 - top) * stride + x1 - left
            box = (min(flat[2::4]), min(flat[::4]), max(flat[3::4]), max(flat[1::4]))
            items.append((-conf, box, stable_id(cls, [(frame, name)]), cls, bits, bits.bit_count(), [(frame, name)]))
        waiting, out = sorted(items, key=lambda i: i[:3]), []
        while waiting:
            (conf, box, _, cls, bits, size, links), waiting = waiting[0], waiting[1:]
            changed = True
            while changed:
                changed, apart = False, []
                for other in waiting:
                    both = (bits & other[4]).bit_count()
                    if both and max(both / (size + other[5] - both), both / min(size, other[5])) >= threshold:
                        bits, size, links, changed = bits | other[4], size + other[5] - both, sorted(links + other[6]), True
                        box = (*map(min, box[:2], other[1][:2]), *map(max, box[2:], other[1][2:]))
                        conf = min(conf, other[0])
                    else:
                        apart.append(other)
                waiting = apart
            out.append((*box, -conf, size, stable_id(cls, links), [f"{f}:{i}" for f, i in links]))
        return [(*key, *r) for r in sorted(out, key=lambda r: (r[:4], -r[4], r[6]))]

    types = ", ".join(f"{g} {footprints.schema[g].dataType.simpleString()}" for g in group)
    form = "rects" if "rects" in footprints.columns else "runs"
    cells = (lambda r: F.array(r["y1"], r["y2"], r["x1"], r["x2"])) if form == "rects" else (lambda r: F.array(r["y"], r["y"] + 1, r["x1"], r["x2"]))
    flat = F.flatten(F.transform(form, cells)).alias("flat")
    rows = footprints.where(F.size(form) > 0).select(*group, "frame", "id", "conf", F.col("cls").alias("cls_of"), flat)
    return sorted_groups(rows, group, work, f"{types}, x1 int, y1 int, x2 int, y2 int, conf double, area int, id string, links array<string>")
