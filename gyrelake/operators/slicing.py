"""Tile windows of large frames: planning, batching, mapping detections back to their frame.

Windows are planned with sequences and one row number per frame; detections join them by slice
index. The window table of a frame is small by construction (its pixels over the stride squared),
so that Spark may broadcast it by its own size threshold; nothing here forces it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.operators import warp
from gyrelake.operators.grouping import sorted_groups

TILE, STRIDE = 1312, 656


def axis_positions(length: Column, tile: int = TILE, stride: int = STRIDE) -> Column:
    """Tile origins along an axis: every stride, the last one against the far edge."""
    steps = F.sequence(F.lit(0), length - tile, F.lit(stride))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(steps, F.array(length - tile))))


def slice_windows(frames: DataFrame, tile: int = TILE, stride: int = STRIDE) -> DataFrame:
    """frame, slice_index, x, y, valid_width, valid_height: row-major windows of every frame (frame, width, height)."""
    w, h = F.col("width").cast("int"), F.col("height").cast("int")
    out = frames.select("frame", "width", "height", F.explode(axis_positions(h, tile, stride)).alias("y"))
    out = out.select("*", F.explode(axis_positions(w, tile, stride)).alias("x"))
    index = F.row_number().over(Window.partitionBy("frame").orderBy("y", "x")) - 1
    return out.select("frame", index.alias("slice_index"), "x", "y", F.least(F.lit(tile), w - F.col("x")).alias("valid_width"), F.least(F.lit(tile), h - F.col("y")).alias("valid_height"))


def batches(windows: DataFrame, size: int) -> DataFrame:
    """Windows with batch_index and place; the last batch of a frame may be short."""
    if size < 1:
        raise ValueError("a batch has at least one window")
    return windows.withColumn("batch_index", F.floor(F.col("slice_index") / size).cast("int")).withColumn("place", F.col("slice_index") % size)


def pixel_batches(windows: DataFrame, blocks: DataFrame, bands: int, batch: int, tile: int = TILE, size: int = warp.BLOCK) -> DataFrame:
    """frame, batch_index, windows and ``tensor``: the bytes of a batch's windows (window, band, line, column), in order.

    ``blocks`` is the frames' raster (``warp.raster_blocks``). Blocks are joined to the windows over them, so that a task holds a batch of
    windows and a block; what a window has beyond its frame is 0. The last batch of a frame may be short.
    """
    same = F.array(*[F.lit(float(k in (0, 4, 8))) for k in range(9)])
    planned = batches(windows, batch).withColumns({"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + tile, "y1": F.col("y") + tile, "m": same})
    planned = planned.withColumns({"width": F.col("x") + F.col("valid_width"), "height": F.col("y") + F.col("valid_height")})

    def cut(target: warp.Target) -> Iterator[tuple]:
        yield (target.values().tobytes(),)

    crops = warp.warp(planned, blocks, ["frame"], ["batch_index", "place"], ["nearest"] * bands, cut, "data binary", size)

    def join(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        parts = [data for _, data in rows]
        yield (*key, len(parts), b"".join(parts))

    return sorted_groups(crops.select("frame", "batch_index", "place", "data"), ["frame", "batch_index"], join, f"frame {windows.schema['frame'].dataType.simpleString()}, batch_index int, windows int, tensor binary", ("place",))


def unknown_slices(windows: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections whose slice is not planned; a map is valid only when there are none."""
    return detections.join(windows.select("frame", "slice_index"), ["frame", "slice_index"], "left_anti")


def valid_detection(classes: int) -> Column:
    """The rule of a detection row: known class, confidence in [0, 1], finite and non-empty box."""
    finite = [~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in ("conf", "x1", "y1", "x2", "y2")]
    out = F.col("cls").between(0, classes - 1) & F.col("conf").between(0.0, 1.0) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    for f in finite:
        out = out & f
    return out


def map_and_clip(windows: DataFrame, detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections in frame coordinates: clipped to the valid part of their tile, dropped when nothing is left."""
    joined = detections.join(windows, ["frame", "slice_index"]).join(frames, "frame")
    clip = {c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(edge).cast("double")) for c, edge in (("x1", "valid_width"), ("x2", "valid_width"), ("y1", "valid_height"), ("y2", "valid_height"))}
    kept = joined.withColumns(clip).where("x2 > x1 and y2 > y1")
    moved = {c: F.least(F.col(c) + F.col(at), F.col(size).cast("double")) for c, at, size in (("x1", "x", "width"), ("x2", "x", "width"), ("y1", "y", "height"), ("y2", "y", "height"))}
    return kept.withColumns(moved).select("frame", "slice_index", "cls", "conf", "x1", "y1", "x2", "y2")


def preprocess(pixel: list[Column], order: str, scale: float, mean: list[float], std: list[float]) -> list[Column]:
    """Channel order, scale, mean and deviation of a tile's pixel (r, g, b), as floats."""
    channels = pixel[::-1] if order == "BGR" else pixel
    return [((c.cast("float") * F.lit(scale).cast("float") - F.lit(m).cast("float")) / F.lit(s).cast("float")).cast("float") for c, m, s in zip(channels, mean, std, strict=True)]


def inside_source(width: Column, height: Column) -> Column:
    """Whether a prediction's box, its ``polygon`` (points x, y; null: none) and its mask's place lie in the source frame."""
    box = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= width) & (F.col("y2") <= height)
    out = F.exists("polygon", lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] > width) | (p["y"] > height))
    mask = (F.col("mask_x") + F.col("mask_width") <= width) & (F.col("mask_y") + F.col("mask_height") <= height)
    return box & ~F.coalesce(out, F.lit(False)) & F.coalesce(mask, F.lit(True))
