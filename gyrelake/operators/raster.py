"""Rasters as pixel rows: blending, coverage, provenance, culling, masks and fills."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_DATA, ACQUIRED, REFERENCE_FILL = 0, 1, 2


def blend(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean colour (truncated, 0..255) and coverage (at most 255) of every canvas pixel.

    pixels: keys, r, g, b and weight w; sums combine before the shuffle, whatever the frames are.
    """
    colour = [F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgb"]
    sums = pixels.where("w > 0").groupBy(*keys).agg(F.sum("w").alias("w"), F.count("*").alias("n"), *colour)
    mean = [F.greatest(F.lit(0), F.least(F.lit(255), (F.col(c) / F.col("w")).cast("int"))).alias(c) for c in "rgb"]
    return sums.select(*keys, *mean, F.least(F.col("n"), F.lit(255)).cast("int").alias("coverage"))


def provenance(canvas: DataFrame, covered: DataFrame, reference: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """x, y, coverage and provenance of every canvas pixel: acquired, filled where only the reference mask (>= 128) is, or none.

    ``within`` names the columns of all three tables that tell the canvases of several acquisitions apart.
    """
    at = [*within, "x", "y"]
    joined = canvas.join(covered.select(*at, "coverage"), at, "left").join(reference.where("mask >= 128").select(*at, F.lit(True).alias("filled")), at, "left")
    n = F.coalesce("coverage", F.lit(0))
    return joined.select(*at, n.alias("coverage"), kind(n, F.col("filled")).alias("provenance"))


def kind(coverage: Column, filled: Column) -> Column:
    """Provenance of a pixel by its coverage and whether the reference mask is there."""
    return F.when(coverage > 0, ACQUIRED).when(filled, REFERENCE_FILL).otherwise(NO_DATA)


def coverage_report(covered: DataFrame) -> DataFrame:
    return covered.agg(F.count_if(F.col("coverage") == 0).alias("uncovered"), F.max("coverage").alias("most"))


def cull(tiles: DataFrame, bounds: DataFrame, group: str = "acq") -> DataFrame:
    """The acquisition's tile and frame wherever a frame's bounds meet a tile: an equi-join on the acquisition."""
    meets = (F.col("right") > F.col("x0")) & (F.col("left") < F.col("x1")) & (F.col("bottom") > F.col("y0")) & (F.col("top") < F.col("y1"))
    return tiles.join(bounds, group).where(meets).select(group, "tile", "frame")


def grid_cull(bounds: DataFrame, columns: int, rows: int, size: int, group: str = "acq") -> DataFrame:
    """acq, tile, frame and n, the number of a frame's distinct bounds that meet a tile of a regular grid, numbered by rows.

    One shuffle of the bounds by acquisition and frame; the tiles that a box may meet follow from its sides, and the
    frame's few boxes are one row when they become tiles, so that no join, sort or aggregate holds rows of tiles.
    """
    at = F.transform(F.collect_set(F.struct("left", "top", "right", "bottom")), lambda b: _tiles(b, columns, rows, size))
    met = bounds.repartition(group, "frame").groupBy(group, "frame").agg(F.flatten(at).alias("met"))
    return met.select(group, "frame", "met", F.explode(F.array_distinct("met")).alias("tile")).select(group, "tile", "frame", F.expr("cast(size(filter(met, t -> t = tile)) as long)").alias("n"))


def _tiles(box: Column, columns: int, rows: int, size: int) -> Column:
    """The numbers of the grid's tiles that a box meets."""

    def span(low: str, high: str, most: int) -> Column:
        first, last = F.greatest(F.floor(box[low] / size), F.lit(0).cast("long")), F.least(F.ceil(box[high] / size) - 1, F.lit(most - 1).cast("long"))
        missing = F.isnull(box[low]) | F.isnull(box[high])
        return F.when(missing | (first > last), F.array().cast("array<long>")).otherwise(F.sequence(first, last))

    across = lambda y: F.transform(span("left", "right", columns), lambda x: y * columns + x)
    return F.flatten(F.transform(span("top", "bottom", rows), across))


def canvas_geometry(corners: DataFrame, group: str) -> DataFrame:
    """Whole-pixel canvas of an acquisition's mapped corners (frame, x, y): origin, width and height."""
    box = corners.groupBy(group).agg(F.floor(F.min("x")).alias("left"), F.floor(F.min("y")).alias("top"), F.ceil(F.max("x")).alias("right"), F.ceil(F.max("y")).alias("bottom"))
    return box.select(group, "left", "top", (F.col("right") - F.col("left") + 1).alias("width"), (F.col("bottom") - F.col("top") + 1).alias("height"))


def beyond_horizon(m: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on or behind the projective horizon of a matrix."""
    return m[6] * x + m[7] * y + m[8] <= 0


def surface(pixels: DataFrame, height: int, fraction: float) -> DataFrame:
    """Pixels without the excluded top share of the image."""
    return pixels.where(F.col("y") >= int(height * fraction))


def annulus(pixels: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    """Acquired pixels in the ring from 0.866 to 1.028 radii, with their whole degree."""
    away = F.hypot(F.col("x") - cx, F.col("y") - cy)
    degree = F.floor(F.pmod(F.degrees(F.atan2(F.col("y") - cy, F.col("x") - cx)), F.lit(360.0))).cast("int")
    return pixels.where((away > 0.866 * radius) & (away < 1.028 * radius)).withColumn("bin", degree)


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.bround(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation, 0..255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, F.bround((top - low) * 255.0 / top)).otherwise(0).cast("int")


def opening(acquired: DataFrame, width: int, height: int, cx: int, cy: int, group: str) -> DataFrame:
    """group, area and radius of the not-acquired component that holds the center; none when it meets the border.

    One preview (bounded by its canvas) for each group; filled from the center in numpy.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        free = np.ones((height, width), bool)
        free[rows["y"].to_numpy(), rows["x"].to_numpy()] = False
        seen = np.zeros_like(free)
        seen[cy, cx] = free[cy, cx]
        while True:
            grown = seen.copy()
            grown[1:] |= seen[:-1]
            grown[:-1] |= seen[1:]
            grown[:, 1:] |= seen[:, :-1]
            grown[:, :-1] |= seen[:, 1:]
            grown &= free
            if (grown == seen).all():
                break
            seen = grown
        if not seen.any() or seen[0].any() or seen[-1].any() or seen[:, 0].any() or seen[:, -1].any():
            return pd.DataFrame()
        y, x = np.nonzero(seen)
        return pd.DataFrame({group: [rows[group].iloc[0]], "area": [len(x)], "radius": [float(np.hypot(x - cx, y - cy).max())]})

    kind = acquired.schema[group].dataType.simpleString()
    return acquired.select(group, "x", "y").groupBy(group).applyInPandas(run, f"{group} {kind}, area long, radius double")


def fill_center(canvas: DataFrame, warped: DataFrame, opened: DataFrame) -> DataFrame:
    """Canvas pixels (x, y, r, g, b, acquired) with the reference colour inside the opening where nothing was acquired."""
    ref = warped.join(opened.select("x", "y"), ["x", "y"]).select("x", "y", *[F.col(c).alias(f"ref_{c}") for c in "rgb"])
    joined = canvas.join(ref, ["x", "y"], "left")
    fill = ~F.col("acquired") & F.col("ref_r").isNotNull()
    return joined.select("x", "y", "acquired", fill.alias("filled"), *[F.when(fill, F.col(f"ref_{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"])


def unknown_provenance(pixels: DataFrame) -> DataFrame:
    """Pixels whose provenance ``p`` is null or none of the known values; a map is valid only when there are none."""
    return pixels.where(~F.coalesce(F.col("p").isin(0, 1, 2, 3), F.lit(False)))
