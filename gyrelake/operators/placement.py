"""Frames on the canvas: the rules of an acquisition's manifest, nominal transforms from a calibration, and transforms corrected by registration.

Everything is joins and map-side aggregates over all acquisitions at once; matrices are arrays of nine doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrelake.functions.geometry import FRAMES, STEP_DEGREES, multiply, rotation_about


def manifest_problems(frames: DataFrame, group: str = "acq") -> DataFrame:
    """group and ``problem`` of each acquisition of frames (position, angle_degrees, sha256): the first rule broken, null when all hold.

    Sixteen frames (``count``), at positions 1 to 16 once each (``positions``), each at its place on the ring (``angles``),
    with different content (``content``). A null breaks the rule that it belongs to.
    """
    on_ring = F.coalesce(F.col("angle_degrees") == (F.col("position") - 1) * STEP_DEGREES, F.lit(False))
    seen = frames.groupBy(group).agg(
        F.count("*").alias("n"), F.count_distinct("position").alias("places"), F.min("position").alias("first"), F.max("position").alias("last"), F.bool_and(on_ring).alias("on_ring"), F.count_distinct("sha256").alias("contents")
    )
    placed = (F.col("places") == FRAMES) & (F.col("first") == 1) & (F.col("last") == FRAMES)
    problem = F.when(F.col("n") != FRAMES, "count").when(~placed, "positions").when(~F.col("on_ring"), "angles").when(F.col("contents") != FRAMES, "content")
    return seen.select(group, problem.alias("problem"))


def angle_sets(angles: DataFrame, count: int, group: str = "acq", column: str = "angle") -> DataFrame:
    """group, ``problem`` and the sorted angles in [0, 360) of each group; the angles are null where there is a problem.

    Exactly ``count`` angles (``count``), all finite (``finite``), no two equal to nine digits (``unique``). Groups are
    of a few angles each.
    """
    turned = F.when(F.abs(F.col(column)) < float("inf"), F.pmod(F.col(column).cast("double"), F.lit(360.0)))
    sets = angles.withColumn("turned__", turned).groupBy(group)
    seen = sets.agg(F.count("*").alias("n"), F.count("turned__").alias("finite"), F.count_distinct(F.round("turned__", 9)).alias("different"), F.sort_array(F.collect_list("turned__")).alias("angles"))
    problem = F.when(F.col("n") != count, "count").when(F.col("finite") != count, "finite").when(F.col("different") != count, "unique")
    return seen.select(group, problem.alias("problem"), F.when(problem.isNull(), F.col("angles")).alias("angles"))


def paired(frames: DataFrame, matrices: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(frames with their matrices, keys without a partner and the side that lacks it): a pairing is strict, so that it holds only when the second is empty."""
    left, right = frames.withColumn("left__", F.lit(True)), matrices.withColumn("right__", F.lit(True))
    both = left.join(right, keys, "full")
    problems = both.where("left__ is null or right__ is null").select(*keys, F.when(F.col("right__").isNull(), "matrix").otherwise("frame").alias("missing"))
    return both.where("left__ and right__").drop("left__", "right__"), problems


def shift(x: Column, y: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(one, zero, x, zero, one, y, zero, zero, one)


def nominal_transforms(frames: DataFrame, calibrations: DataFrame, group: str = "acq") -> DataFrame:
    """frames (position, angle_degrees) with source_to_output and output_to_source by their calibration (cx, cy, ox, oy: the centers in source and output).

    The source's center moves onto the output's, then the frame turns about it by its angle. Frames without a calibration give no row.
    """
    joined = frames.join(calibrations.select(group, "cx", "cy", "ox", "oy"), group)
    dx, dy = F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy")
    turn = lambda angle: rotation_about(F.col("ox"), F.col("oy"), angle)
    there = multiply(turn(F.col("angle_degrees")), shift(dx, dy))
    back = multiply(shift(-dx, -dy), turn(-F.col("angle_degrees")))
    return joined.withColumns({"source_to_output": there, "output_to_source": back}).drop("cx", "cy")


def corrected_transforms(transforms: DataFrame, corrections: DataFrame, group: str = "acq") -> DataFrame:
    """Nominal transforms (with ox, oy) turned further about the output's center by the corrections (frame, correction, ok) of ``ring_corrections``.

    Only acquisitions whose ring is ``ok`` in every frame have corrected transforms; the others give no row.
    """
    whole = corrections.groupBy(group).agg(F.bool_and("ok").alias("ok"), F.count_distinct("frame").alias("n")).where(F.col("ok") & (F.col("n") == FRAMES)).select(group)
    turned = corrections.join(whole, group).select(group, F.col("frame").alias("position"), "correction")
    joined = transforms.join(turned, [group, "position"])
    turn = lambda angle: rotation_about(F.col("ox"), F.col("oy"), angle)
    there = multiply(turn(F.col("correction")), F.col("source_to_output"))
    back = multiply(F.col("output_to_source"), turn(-F.col("correction")))
    return joined.withColumns({"source_to_output": there, "output_to_source": back})


def frames_of(frames: DataFrame, run_id: str) -> DataFrame:
    """The source frames of one run in the order of their index."""
    return frames.where(F.col("run_id") == run_id).orderBy("frame_index")


def snapshot_id(pipeline_id: Column, revision: Column) -> Column:
    """The id of a pipeline's saved revision."""
    return F.concat(pipeline_id, F.lit("-r"), revision.cast("string"))
