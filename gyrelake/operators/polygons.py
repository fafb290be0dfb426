"""Polygons as footprints: scan conversion to runs of whole pixels, many polygons of an Arrow batch at once.

Corners are (x, y) on the canvas. The fill looks at a window: whole pixels round the polygon, cut to the
canvas. Corners become whole numbers relative to the window's corner, fractions cut off towards it. On a line y every edge that
is not level and reaches it, both ends included, crosses at some x; an edge that ends there, unless y is the polygon's last line,
counts twice, so that crossings pair up at corners, touching and repeated ones too. Crossings in order are taken in pairs
(even-odd rule): pixels from the first, halves up, to the second, halves down, both included. Level edges are
filled from end to end. Runs that meet are joined, so that a footprint's runs are disjoint and in order.

No shuffle: a row in, a row out. A task holds an Arrow batch and the crossings of about ``CROSSINGS`` lines and edges of it (those of one
polygon at least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CROSSINGS = 1_000_000
RUNS = "array<struct<y:int,x1:int,x2:int>>"
_ARROW = pa.struct([("y", pa.int32()), ("x1", pa.int32()), ("x2", pa.int32())])


def scan(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, canvas: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(polygon, y, x1, x2) of all runs, in order, of polygons of so many corners each."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left, top = (np.maximum(0, np.floor(np.minimum.reduceat(v, first))) for v in (x, y))
    right, bottom = (np.minimum(side, np.ceil(np.maximum.reduceat(v, first))) for v, side in zip((x, y), canvas, strict=True))
    of = np.repeat(np.arange(len(sizes)), sizes)
    ax, ay = np.trunc(x - left[of]) + left[of], np.trunc(y - top[of]) + top[of]
    following = np.arange(len(x)) + 1
    following[first + sizes - 1] = first
    bx, by = ax[following], ay[following]
    last = np.maximum.reduceat(ay, first)
    low, high, open_ = np.minimum(ay, by), np.maximum(ay, by), (left < right)[of] & (top < bottom)[of]

    start, end = np.maximum(low, top[of]), np.minimum(high, bottom[of] - 1)  # the lines of each edge inside the window
    n = np.where((ay != by) & open_, np.maximum(0, end - start + 1), 0).astype(np.int64)
    edge = np.repeat(np.arange(len(x)), n)
    line = start[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
    at = (line - ay[edge]) * ((bx[edge] - ax[edge]) / (by[edge] - ay[edge])) + ax[edge]
    twice = np.where((high[edge] == line) & (line < last[of[edge]]), 2, 1)
    group, line, at = (np.repeat(v, twice) for v in (of[edge], line, at))
    order = np.lexsort((at, line, group))
    group, line, at = group[order], line[order], at[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (line[1:] != line[:-1])
    rank = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    pair = np.flatnonzero((rank % 2 == 0) & ~np.append(new[1:], True))
    level = np.flatnonzero((ay == by) & open_ & (ay >= top[of]) & (ay < bottom[of]))
    group = np.concatenate([group[pair], of[level]])
    line = np.concatenate([line[pair], ay[level]])
    x1 = np.maximum(np.concatenate([np.floor(at[pair] + 0.5), np.minimum(ax, bx)[level]]), left[group])
    x2 = np.minimum(np.concatenate([np.ceil(at[pair + 1] - 0.5), np.maximum(ax, bx)[level]]) + 1, right[group])
    some = x1 < x2
    return joined(*(v[some].astype(np.int64) for v in (group, line, x1, x2)))


def joined(group: np.ndarray, line: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order, those of a line that meet made one."""
    order = np.lexsort((x1, line, group))
    group, line, x1, x2 = group[order], line[order], x1[order], x2[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (line[1:] != line[:-1])
    far = int(x2.max(initial=0)) + 1
    reach = np.maximum.accumulate(np.cumsum(new) * far + x2)  # of a line's runs so far; a later line is beyond all of an earlier one
    new[1:] |= np.cumsum(new)[1:] * far + x1[1:] > reach[:-1]
    begins = np.flatnonzero(new)
    return group[begins], line[begins], x1[begins], np.maximum.reduceat(x2, begins) if len(begins) else x2


def polygon_runs(polygons: DataFrame, keys: list[str], canvas: tuple[int, int], corners: str = "corners") -> DataFrame:
    """Footprints (keys, ``runs`` of y, x1, x2) of polygons given as arrays of (x, y).

    Polygons off the canvas, without corners, or with a null or non-finite corner have no footprint and no row.
    """
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e15)
    known = polygons.where((F.size(corners) > 0) & F.forall(corners, lambda p: p.isNotNull() & good(p["x"]) & good(p["y"])))
    xs, ys = (F.col(f"{corners}.{n}").cast("array<double>").alias(f"{n}__") for n in ("x", "y"))
    kinds = ", ".join(f"`{k}` {polygons.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = pc.list_flatten(batch["y__"]).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(batch["y__"]).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(sizes):
                continue
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            tall = np.minimum(np.maximum.reduceat(ys, first), canvas[1]) - np.maximum(np.minimum.reduceat(ys, first), 0)
            cost = np.cumsum(sizes * (np.maximum(tall, 0) + 2))
            at = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CROSSINGS, "right")))
                part = batch.slice(at, to - at)
                x, y = (pc.list_flatten(part[c]).to_numpy(zero_copy_only=False) for c in ("x__", "y__"))
                group, line, x1, x2 = scan(sizes[at:to], x, y, canvas)
                ends = np.searchsorted(group, np.arange(to - at + 1))
                some = np.flatnonzero(np.diff(ends))
                runs = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (line, x1, x2)], fields=list(_ARROW))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)
                yield pa.record_batch([*[part[k] for k in keys], lists], [*keys, "runs"]).take(pa.array(some))
                at = to

    return known.select(*keys, xs, ys).mapInArrow(run, f"{kinds}, runs {RUNS}")
