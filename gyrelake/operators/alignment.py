"""Angular profiles of the center flash and their alignment to a reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.functions.geometry import circular_difference

BINS = 360


def angular_profile(samples: DataFrame, spark) -> DataFrame:
    """bin 0..359 and score: the mean of v * (1 - sat / 510) in each degree, 0 for an empty one."""
    means = samples.groupBy("bin").agg(F.sum(F.col("v") * (1 - F.col("sat") / 510.0)).alias("s"), F.count("*").alias("n"))
    bins = spark.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return bins.join(means, "bin", "left").select("bin", F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("score"))


def circular_mean(profile: DataFrame, width: int = 11) -> DataFrame:
    """The profile with ``smooth``: the mean of ``width`` bins around each, over the seam."""
    half = width // 2
    wrapped = profile.select("bin", "score", F.explode(F.array(F.lit(-BINS), F.lit(0), F.lit(BINS))).alias("turn")).withColumn("at", F.col("bin") + F.col("turn"))
    near = wrapped.where(F.col("at").between(-half, BINS - 1 + half))
    mean = F.avg("score").over(Window.orderBy("at").rowsBetween(-half, half))  # 360 bins and the seam
    return near.withColumn("smooth", mean).where("turn = 0").select("bin", "score", "smooth")


def peaks(values: np.ndarray, distance: int, prominence: float) -> list[tuple[int, float]]:
    """Local maxima (middle of a plateau), the higher kept within a distance, then those prominent enough."""
    n, found, i = len(values), [], 1
    while i < n - 1:
        if values[i - 1] < values[i]:
            j = i
            while j + 1 < n and values[j + 1] == values[i]:
                j += 1
            if j + 1 < n and values[j + 1] < values[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    keep = np.ones(len(found), bool)
    at = np.array(found, int)
    for k in np.argsort(values[at], kind="stable")[::-1] if len(at) else []:
        if keep[k]:
            near = (np.abs(at - at[k]) < distance) & (np.arange(len(at)) != k)
            keep[near] = False
    out = []
    for p in at[keep]:
        left, k = values[p], p
        while k >= 0 and values[k] <= values[p]:
            left, k = min(left, values[k]), k - 1
        right, k = values[p], p
        while k < n and values[k] <= values[p]:
            right, k = min(right, values[k]), k + 1
        rise = values[p] - max(left, right)
        if rise >= prominence:
            out.append((int(p), float(rise)))
    return out


def flash_angles(scores: np.ndarray, count: int = 10, width: int = 11, distance: int = 15, prominence: float = 2.0) -> list[int]:
    """The ``count`` most prominent circular peaks of 360 finite scores, by angle; ValueError when there are fewer."""
    if len(scores) != BINS or not np.isfinite(scores).all() or width % 2 == 0 or not 1 <= width <= 31:
        raise ValueError("360 finite scores and an odd width up to 31")
    half = width // 2
    around = np.concatenate([scores[BINS - half :], scores, scores[:half]]) if half else scores
    smooth = np.convolve(around, np.ones(width) / width, "valid")
    three = np.tile(smooth, 3)
    found = [(p - BINS, rise) for p, rise in peaks(three, distance, prominence) if BINS <= p < 2 * BINS]
    if len(found) < count:
        raise ValueError(f"{len(found)} peaks of {count}")
    best = sorted(found, key=lambda x: (-x[1], -smooth[x[0]], x[0]))[:count]
    return sorted(p for p, _ in best)


def peak_table(profiles: DataFrame, group: str, **options) -> DataFrame:
    """group, place and angle of the peaks of each group's profile (bin, score); groups without enough peaks give none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        scores = np.zeros(BINS)
        scores[rows["bin"].to_numpy()] = rows["score"].to_numpy()
        try:
            found = flash_angles(scores, **options)
        except ValueError:
            found = []
        if not found:
            return pd.DataFrame()
        return pd.DataFrame({group: [rows[group].iloc[0]] * len(found), "place": range(len(found)), "angle": found})

    kind = profiles.schema[group].dataType.simpleString()
    return profiles.select(group, "bin", "score").groupBy(group).applyInPandas(run, f"{group} {kind}, place int, angle int")


def cyclic_alignments(source: DataFrame, target: DataFrame, coarse: float, n: int = 10, period: float = 36.0, group: tuple[str, ...] = ()) -> DataFrame:
    """Every cyclic shift of n sorted angles against n others: raw turn, rotation, median and greatest residual.

    source and target have place 0..n-1 and angle, once for each ``group``. The raw turn is the median circular difference;
    the rotation moves it by whole periods (half to even) to be nearest the coarse estimate.
    """
    shifts = source.select(*group, F.col("angle").alias("a"), "place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shift"))
    shifts = shifts.withColumn("j", (F.col("place") + F.col("shift")) % n).drop("place")
    both = shifts.join(target.select(*group, F.col("place").alias("j"), F.col("angle").alias("b")), [*group, "j"])
    both = both.withColumn("difference", circular_difference(F.col("b"), F.col("a")))
    # n differences of a shift: medians over n rows
    lists = both.groupBy(*group, "shift").agg(F.median("difference").alias("raw"), F.collect_list(F.struct("a", "b")).alias("ab"))
    scored = lists.select(*group, "shift", "raw", F.explode("ab").alias("p")).withColumn("off", F.abs(circular_difference(F.col("p.a") + F.col("raw"), F.col("p.b"))))
    out = scored.groupBy(*group, "shift").agg(F.first("raw").alias("raw"), F.median("off").alias("median_off"), F.max("off").alias("most_off"))
    steps = F.bround((F.lit(coarse) - F.col("raw")) / period)
    return out.withColumn("rotation", F.pmod(F.col("raw") + period * steps, F.lit(360.0)))


def best_alignment(alignments: DataFrame, coarse: float, group: tuple[str, ...] = ()) -> DataFrame:
    """The shift of least median, then greatest residual, then distance from the estimate, then shift, of each group."""
    away = F.abs(circular_difference(F.col("rotation"), F.lit(coarse)))
    return alignments.groupBy(*group).agg(F.min(F.struct("median_off", "most_off", away.alias("away"), "shift", "raw", "rotation")).alias("b")).select(*group, "b.shift", "b.raw", "b.rotation", "b.median_off", "b.most_off")


def upper_plans(profiles: DataFrame) -> DataFrame:
    """profiles with rotation, scale and the affine (a, b, tx, c, d, ty) that turns the plate's marker to the start ray.

    profiles: source_x, source_y, source_radius, marker_x, marker_y, target_x, target_y, target_radius,
    ray (degrees). A target radius that is null, not finite or not positive gives nulls.
    """
    marker = F.degrees(F.atan2(F.col("marker_y") - F.col("source_y"), F.col("marker_x") - F.col("source_x")))
    radius = F.when((F.col("target_radius") > 0) & (F.col("target_radius") < float("inf")), F.col("target_radius"))
    out = profiles.withColumns({"rotation": F.when(radius.isNotNull(), circular_difference(F.col("ray"), marker)), "scale": radius / F.col("source_radius")})
    c, s = F.cos(F.radians("rotation")) * F.col("scale"), F.sin(F.radians("rotation")) * F.col("scale")
    tx = F.col("target_x") - c * F.col("source_x") + s * F.col("source_y")
    ty = F.col("target_y") - s * F.col("source_x") - c * F.col("source_y")
    return out.withColumn("affine", F.when(radius.isNotNull(), F.array(c, -s, tx, s, c, ty)))
