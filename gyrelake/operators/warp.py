"""Rasters in square blocks and their warps: tiles of a canvas gather from the blocks that they reach.

A raster is rows (keys, bx, by, data): bytes of all bands of a block, one after another; blocks that are
absent are blank. A target is a stretch (x0, y0, x1, y1) of an output with the homography ``m`` (nine doubles,
output to source) and the source's width and height. An output pixel takes its value from the point that its
center maps to; outside the source it is blank and not valid. A tap beyond the edge counts as the edge.

Each target is joined, by an equi-join on (keys, bx, by), with the blocks that its corners enclose, and
its blocks stream by in order: a task holds one target's sums and one block, whatever the image's size is.
Every tap of the kernels (1 nearest, 4 bilinear, 16 bicubic) lies in exactly one block and is added when that
block passes, so that no halo is copied. A target that crosses the horizon of its matrix is joined
with all blocks of the source. Nulls in ``m`` or in a stretch give no output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.operators.grouping import sorted_groups

BLOCK, TILE = 64, 256
#: First tap of a kernel beside the pixel that holds the point, and number of taps on an axis.
KERNELS = {"nearest": (0, 1), "bilinear": (0, 2), "bicubic": (-1, 4)}
FEATHER = 512.0
#: Sums this close below a whole number are that number.
CLOSE = 1e-9


def raster_blocks(pixels: DataFrame, keys: list[str], bands: list[str], size: int = BLOCK) -> DataFrame:
    """keys, bx, by and data of pixel rows (keys, x, y, bands of 0..255); of a repeated pixel each band's greatest value counts."""

    def pack(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        at = np.array(rows, np.int64).reshape(-1, 2 + len(bands))
        block = np.zeros((len(bands), size, size), np.uint8)
        for k in range(len(bands)):
            block[k, at[:, 1] % size, at[:, 0] % size] = at[:, 2 + k]
        yield (*key, block.tobytes())

    once = pixels.groupBy(*keys, "x", "y").agg(*[F.max(b).alias(b) for b in bands])
    cell = [F.floor(F.col(c) / size).cast("int").alias(b) for c, b in (("x", "bx"), ("y", "by"))]
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    return sorted_groups(once.select(*keys, *cell, "x", "y", *bands), [*keys, "bx", "by"], pack, f"{kinds}, bx int, by int, data binary")


def stretches(frame: DataFrame, left: Column, top: Column, right: Column, bottom: Column, size: int = TILE) -> DataFrame:
    """The rows of ``frame`` once for each tile (x0, y0, x1, y1) of a rectangle; empty rectangles give none."""
    steps = lambda a, b: F.when(a < b, F.sequence(a.cast("int"), b.cast("int") - 1, F.lit(size)))
    across = frame.withColumn("x0", F.explode(steps(left, right)))
    both = across.withColumn("y0", F.explode(steps(top, bottom)))
    return both.withColumns({"x1": F.least(F.col("x0") + size, right).cast("int"), "y1": F.least(F.col("y0") + size, bottom).cast("int")})


def reached(targets: DataFrame, size: int, halo: int = 3, gate: float = 1e-12) -> DataFrame:
    """targets once for each block (bx, by) that their stretch may take a tap from."""
    x, y = [F.col("x0") + 0.5, F.col("x1") - 0.5], [F.col("y0") + 0.5, F.col("y1") - 0.5]
    corners = [(a, b) for a in x for b in y]
    # step by step, so that no expression is written out again for each of its uses
    out = targets.withColumns({f"m__{k}": F.col("m")[k] for k in range(9)})
    out = out.withColumns({f"w__{i}": F.col("m__6") * a + F.col("m__7") * b + F.col("m__8") for i, (a, b) in enumerate(corners)})
    out = out.withColumns({f"{n}__{i}": (F.col(f"m__{k}") * a + F.col(f"m__{k + 1}") * b + F.col(f"m__{k + 2}")) / F.nullif(F.col(f"w__{i}"), F.lit(0.0)) for n, k in (("u", 0), ("v", 3)) for i, (a, b) in enumerate(corners)})
    w = [F.col(f"w__{i}") for i in range(4)]
    out = out.withColumn("apart__", (F.least(*w) > gate) | (F.greatest(*w) < -gate))
    edges = {}
    for n, side in (("u", "width"), ("v", "height")):
        at, last = [F.col(f"{n}__{i}") for i in range(4)], F.floor((F.col(side) - 1) / size)
        edges |= {
            f"{n}_from__": F.when(F.col("apart__"), F.greatest(F.lit(0), F.floor((F.least(*at) - halo) / size))).otherwise(0).cast("int"),
            f"{n}_to__": F.when(F.col("apart__"), F.least(last, F.floor((F.greatest(*at) + halo) / size))).otherwise(last).cast("int"),
        }
    out = out.withColumns(edges)
    for n, b in (("u", "bx"), ("v", "by")):
        a, z = F.col(f"{n}_from__"), F.col(f"{n}_to__")
        out = out.withColumn(b, F.explode_outer(F.when(a <= z, F.sequence(a, z))))
    return out.select(*targets.columns, "bx", "by")


def weights(kernel: str, d: np.ndarray) -> list[np.ndarray]:
    """Of each tap on an axis, for points at d beyond the center of the pixel before them."""
    if kernel == "nearest":
        return [np.ones_like(d)]
    if kernel == "bilinear":
        return [1 - d, d]
    return [d * (-1 + d * (2 - d)), 1 + d * d * (d - 2), d * (1 + d * (1 - d)), d * d * (d - 1)]


class Target:
    """The sums of a stretch: the source point of each pixel, its taps, and what has been added."""

    def __init__(self, m: list[float], stretch: tuple[int, int, int, int], source: tuple[int, int], kernels: list[str]):
        self.stretch, self.source, self.m = stretch, source, m
        x0, y0, x1, y1 = stretch
        x, y = np.meshgrid(np.arange(x0, x1) + 0.5, np.arange(y0, y1) + 0.5)
        self.u, self.v = self.point(x.ravel(), y.ravel())
        with np.errstate(invalid="ignore"):
            self.valid = (self.u >= 0) & (self.u < source[0]) & (self.v >= 0) & (self.v < source[1])
        self.at = np.flatnonzero(self.valid)
        self.kernels, self.sums = kernels, np.zeros((len(kernels), len(self.at)))
        self.taps = {k: self._axes(k) for k in set(kernels)}

    def point(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.m
        with np.errstate(divide="ignore", invalid="ignore"):
            w = m[6] * x + m[7] * y + m[8]
            return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w

    def _axes(self, kernel: str) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
        """For both axes: the source row or column of each tap, and its weight."""
        first, n = KERNELS[kernel]
        out = []
        for value, side in ((self.u[self.at], self.source[0]), (self.v[self.at], self.source[1])):
            value = value if kernel == "nearest" else value - 0.5
            base = np.floor(value)
            cells = [np.clip(base.astype(np.int64) + first + i, 0, side - 1) for i in range(n)]
            out.append((cells, weights(kernel, value - base)))
        return out

    def add(self, bx: int, by: int, data: bytes, size: int) -> None:
        """Adds the taps that lie in a block."""
        block = np.frombuffer(data, np.uint8).reshape(len(self.kernels), size, size)
        for kernel, ((xs, wx), (ys, wy)) in self.taps.items():
            bands = [k for k, name in enumerate(self.kernels) if name == kernel]
            near = np.flatnonzero((xs[0] < (bx + 1) * size) & (xs[-1] >= bx * size) & (ys[0] < (by + 1) * size) & (ys[-1] >= by * size))
            for y, b in zip(ys, wy, strict=True):
                y, b = y[near], b[near]
                for x, a in zip(xs, wx, strict=True):
                    x = x[near]
                    hit = np.flatnonzero((x // size == bx) & (y // size == by))
                    share, to = a[near[hit]] * b[hit], near[hit]
                    for k in bands:
                        self.sums[k, to] += share * block[k, y[hit] - by * size, x[hit] - bx * size]

    def values(self) -> np.ndarray:
        """[band, pixel] of the stretch, 0..255; fractions are cut off."""
        out = np.zeros((len(self.kernels), len(self.u)), np.uint8)
        out[:, self.at] = np.clip(np.floor(self.sums + CLOSE), 0, 255).astype(np.uint8)
        return out

    def feather(self) -> np.ndarray:
        """Blend weights: how far a pixel's own point is from the source's nearest edge, at most ``FEATHER``; 0 where it is not valid."""
        x0, y0, x1, y1 = self.stretch
        x, y = np.meshgrid(np.arange(x0, x1, dtype=float), np.arange(y0, y1, dtype=float))
        u, v = self.point(x.ravel(), y.ravel())
        with np.errstate(invalid="ignore"):
            near = np.minimum.reduce((u + 1, self.source[0] - u, v + 1, self.source[1] - v, np.full(u.shape, FEATHER)))
        return np.where(self.valid, np.clip(near, 0, FEATHER), 0).astype(np.float32)


def warp(targets: DataFrame, blocks: DataFrame, keys: list[str], outputs: list[str], kernels: list[str], finish: Callable[[Target], Iterable[tuple]], schema: str, size: int = BLOCK) -> DataFrame:
    """Runs ``finish`` over each target when all its blocks have passed.

    ``keys`` tell the sources apart and are columns of targets and blocks; ``outputs`` are further columns of
    targets that tell the outputs apart. The result has keys, outputs and the columns of ``schema``.
    """
    whole = ["x0", "y0", "x1", "y1", "width", "height", "m"]
    known = targets.where(~F.exists("m", lambda v: v.isNull()) & F.col("x0").isNotNull()).select(*keys, *outputs, *whole)
    joined = reached(known, size).join(blocks.select(*keys, "bx", "by", "data"), [*keys, "bx", "by"], "left")
    group = [*keys, *outputs, "x0", "y0"]

    def run(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        target = None
        for by, bx, x1, y1, width, height, m, data in rows:
            if target is None:
                target = Target(m, (*key[-2:], x1, y1), (width, height), kernels)
            if data is not None:
                target.add(bx, by, data, size)
        for row in finish(target):
            yield (*key[:-2], *row)

    kinds = [f"{k} {targets.schema[k].dataType.simpleString()}" for k in [*keys, *outputs]]
    return sorted_groups(joined.select(*group, "by", "bx", "x1", "y1", "width", "height", "m", "data"), group, run, ", ".join([*kinds, schema]), ("by", "bx"))


TILE_KIND = "x0 int, y0 int, x1 int, y1 int, data binary, valid binary, weight binary"


def warp_tiles(targets: DataFrame, blocks: DataFrame, keys: list[str], outputs: list[str], kernels: list[str], size: int = BLOCK) -> DataFrame:
    """A row for each target: data (bytes, band after band), valid (a byte for each pixel) and weight (a 32-bit float for each)."""

    def tile(target: Target) -> Iterator[tuple]:
        yield (*target.stretch, target.values().tobytes(), target.valid.astype(np.uint8).tobytes(), target.feather().tobytes())

    return warp(targets, blocks, keys, outputs, kernels, tile, TILE_KIND, size)


def tile_pixels(tiles: DataFrame, keep: list[str], bands: list[str]) -> DataFrame:
    """The valid pixels of warped tiles as rows: keep, x, y, bands and the blend weight w."""
    columns = ["x0", "y0", "x1", "y1", "data", "valid", "weight"]
    kinds = ", ".join([*[f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keep], "x int, y int", *[f"{b} int" for b in bands], "w float"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x0, y0, x1, y1, data, valid, weight = (batch[c][row].as_py() for c in columns)
                at = np.flatnonzero(np.frombuffer(valid, np.uint8))
                values = np.frombuffer(data, np.uint8).reshape(len(bands), -1)[:, at].astype(np.int32)
                y, x = np.divmod(at, x1 - x0)
                same = [pa.repeat(batch[k][row], len(at)) for k in keep]
                arrays = [pa.array((x + x0).astype(np.int32)), pa.array((y + y0).astype(np.int32)), *map(pa.array, values), pa.array(np.frombuffer(weight, np.float32)[at])]
                yield pa.record_batch([*same, *arrays], [*keep, "x", "y", *bands, "w"])

    return tiles.select(*keep, *columns).mapInArrow(unpack, kinds)


def adjugate(m: list[Column]) -> Column:
    """The inverse of a homography up to a factor, which homogeneous points don't see."""
    minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    return F.array(minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4))


def mask_bounds(masks: DataFrame, canvas: tuple[int, int], most: int, gate: float = 1e-12) -> DataFrame:
    """masks (x, y, width, height in their frame, ``m`` from frame to canvas) with left, top, right, bottom on the canvas and ``problem``.

    The problem is ``infinite`` where a corner has no point on the canvas's plane, ``budget`` where the
    rectangle holds more than ``most`` pixels, ``outside`` where nothing of it is on the canvas, else null. ``m`` becomes canvas to mask.
    """
    # cell by cell and step by step, so that no expression is written out again for each of its uses
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    cells = {f"t__{3 * i + j}": F.col("m")[3 * i + j] for i in range(3) for j in range(2)}
    cells |= {f"t__{3 * i + 2}": F.col("m")[3 * i] * x + F.col("m")[3 * i + 1] * y + F.col("m")[3 * i + 2] for i in range(3)}
    t, out = [F.col(f"t__{k}") for k in range(9)], masks.withColumns(cells)
    corners = [(a, b) for a in (F.lit(0.0), F.col("width").cast("double")) for b in (F.lit(0.0), F.col("height").cast("double"))]
    out = out.withColumns({f"w__{i}": t[6] * a + t[7] * b + t[8] for i, (a, b) in enumerate(corners)})
    w = [F.col(f"w__{i}") for i in range(4)]
    out = out.withColumn("known__", F.least(*[F.abs(v) for v in w]) > gate)
    out = out.withColumns({f"{n}__{i}": F.when(F.col("known__"), (t[k] * a + t[k + 1] * b + t[k + 2]) / w[i]) for n, k in (("u", 0), ("v", 3)) for i, (a, b) in enumerate(corners)})
    lo = lambda n: F.greatest(F.lit(0), F.floor(F.least(*[F.col(f"{n}__{i}") for i in range(4)]))).cast("int")
    hi = lambda n, side: F.least(F.lit(side), F.ceil(F.greatest(*[F.col(f"{n}__{i}") for i in range(4)]))).cast("int")
    out = out.withColumns({"left": lo("u"), "top": lo("v"), "right": hi("u", canvas[0]), "bottom": hi("v", canvas[1])})
    size = (F.col("right") - F.col("left")).cast("long") * (F.col("bottom") - F.col("top"))
    empty = (F.col("left") >= F.col("right")) | (F.col("top") >= F.col("bottom"))
    problem = F.when(~F.col("known__"), "infinite").when(empty, "outside").when(size > most, "budget")
    return out.withColumns({"problem": problem, "m": adjugate(t)}).select(*masks.columns, "left", "top", "right", "bottom", "problem")


def warp_masks(bounded: DataFrame, blocks: DataFrame, keys: list[str], size: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Footprints (keys, ``runs`` of y, x1, x2) of the masks of ``mask_bounds`` that have no problem, by the nearest source pixel.

    A mask without a set pixel on the canvas gives no row.
    """

    def lines(target: Target) -> Iterator[tuple]:
        x0, y0, x1, y1 = target.stretch
        bits = np.zeros((y1 - y0, x1 - x0 + 2), np.int8)
        bits[:, 1:-1] = target.values().reshape(y1 - y0, x1 - x0) > 0
        steps = np.diff(bits, axis=1)
        for (y, a), (_, b) in zip(np.argwhere(steps == 1).tolist(), np.argwhere(steps == -1).tolist(), strict=True):
            yield y + y0, a + x0, b + x0

    targets = stretches(bounded.where("problem is null"), F.col("left"), F.col("top"), F.col("right"), F.col("bottom"), tile)
    return gathered_runs(warp(targets, blocks, keys, [], ["nearest"], lines, "y int, x1 int, x2 int", size), keys)


def gathered_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Footprints of run rows (keys, y, x1, x2): runs of a line that touch or overlap become one."""
    line = Window.partitionBy(*keys, "y").orderBy("x1", "x2")
    before = F.max("x2").over(line.rowsBetween(Window.unboundedPreceding, -1))
    begun = rows.withColumn("new__", F.when(F.col("x1") <= before, 0).otherwise(1))
    whole = begun.withColumn("run__", F.sum("new__").over(line)).groupBy(*keys, "y", "run__").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"))
    return whole.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x1", "x2"))).alias("runs"))
