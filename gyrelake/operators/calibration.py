"""Calibration from correspondences: a robust similarity for each pair of frames, then center, bands and matrices of each acquisition.

Correspondences are rows (acq, source_frame, target_frame, part, sx, sy, tx, ty); ``part`` is ``fit`` or
``held``. A pair's rows are at most what a matcher keeps of two images, so that a task holds one pair at a time in a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrelake.functions.geometry import FRAMES, rotation_center
from gyrelake.operators.grouping import sorted_groups
from gyrelake.operators.registration import calibration_reason, radial_bands, robust_center

#: How far an inlier may be, most draws, wanted certainty, and refits, of the consensus.
REACH_PX, DRAWS, SURE, REFITS = 2.0, 5000, 0.999, 10
DRAWN_AT_ONCE = 256
#: Share of the image's height above the region of interest.
ROI_TOP = 0.18
FAILED = "partial-affine fit failed"


def fit_similarity(s: np.ndarray, t: np.ndarray) -> tuple[complex, complex] | None:
    """a and b of t = a s + b in the least-squares sense, points as complex numbers; None where all s are one point."""
    ms, mt = s.mean(), t.mean()
    spread = (np.abs(s - ms) ** 2).sum()
    if spread <= 1e-12:
        return None
    a = (np.conj(s - ms) * (t - mt)).sum() / spread
    return a, mt - a * ms


def consensus(s: np.ndarray, t: np.ndarray, seed: int) -> tuple[complex, complex, np.ndarray] | None:
    """(a, b, inliers) of the similarity that most points agree with.

    Pairs of points are drawn by a seeded generator, a few hundred at once, until one without an outlier has been
    drawn with certainty ``SURE`` at the share of inliers seen so far, or ``DRAWS`` are made; ties go to the earlier
    draw. The best is fitted anew to its inliers until they stay.
    """
    n = len(s)
    if n < 2:
        return None
    rng, best, drawn, needed = np.random.default_rng(seed), (1, None), 0, DRAWS
    while drawn < needed:
        i = rng.integers(0, n, DRAWN_AT_ONCE)
        j = (i + rng.integers(1, n, DRAWN_AT_ONCE)) % n
        apart = s[j] - s[i]
        use = np.abs(apart) > 1e-9
        i, j, apart = i[use], j[use], apart[use]
        drawn += DRAWN_AT_ONCE
        if not len(i):
            continue
        a = (t[j] - t[i]) / apart
        b = t[i] - a * s[i]
        inside = np.abs(a[:, None] * s + b[:, None] - t) <= REACH_PX
        count = inside.sum(1)
        top = int(count.argmax())
        if count[top] > best[0]:
            best = (int(count[top]), inside[top])
            clean = (best[0] / n) ** 2
            needed = min(DRAWS, drawn if clean >= 1 else int(np.ceil(np.log(1 - SURE) / np.log(1 - clean))))
    inside = best[1]
    if inside is None:
        return None
    for _ in range(REFITS):
        if (fit := fit_similarity(s[inside], t[inside])) is None:
            return None
        now = np.abs(fit[0] * s + fit[1] - t) <= REACH_PX
        if now.sum() < 2 or (now == inside).all():
            break
        inside = now
    return (*fit, inside) if fit[0] != 0 else None


def pair_similarities(correspondences: DataFrame, group: str = "acq") -> DataFrame:
    """A row for each pair of frames: the similarity (a, b, c, d, tx, ty; rows a b tx and c d ty), angle_degrees, scale, inlier_count and residual_px.

    residual_px is the median distance of the held points, null without any. A pair without two different
    points, or with no two that agree, has nulls and ``reason``. Points with a null or non-finite number are left out.
    """
    pair = [group, "source_frame", "target_frame"]

    def work(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        at = np.array([r[1:] for r in rows], float).reshape(-1, 4)
        held, good = np.array([r[0] == "held" for r in rows], bool), np.isfinite(at).all(1)
        s, t = at[:, 0] + 1j * at[:, 1], at[:, 2] + 1j * at[:, 3]
        seed = int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "little")
        found = consensus(s[good & ~held], t[good & ~held], seed)
        if found is None:
            yield (*key, *[None] * 8, 0, None, FAILED)
            return
        a, b, inside = found
        away = np.abs(a * s[good & held] + b - t[good & held])
        middle = float(np.median(away)) if len(away) else None
        angle, scale = float(np.degrees(np.angle(a))), float(np.abs(a))
        yield (*key, a.real, -a.imag, a.imag, a.real, b.real, b.imag, angle, scale, int(inside.sum()), middle, None)

    kinds = ", ".join(f"{k} {correspondences.schema[k].dataType.simpleString()}" for k in pair)
    numbers = [F.col(c).cast("double").alias(c) for c in ("sx", "sy", "tx", "ty")]
    known = correspondences.select(*pair, "part", *numbers).na.drop(subset=["part", "sx", "sy", "tx", "ty"])
    # the draws see points in a fixed order, whatever the shuffle did
    ordered = sorted_groups(known, pair, lambda key, rows: work(key, list(rows)), f"{kinds}, a double, b double, c double, d double, tx double, ty double, angle_degrees double, scale double, inlier_count int, residual_px double, reason string", ("part", "sx", "sy", "tx", "ty"))
    return ordered


def calibrate(pairs: DataFrame, width: int, height: int, group: str = "acq") -> DataFrame:
    """The calibration of each acquisition from its sixteen pairs: center, reference ray, radial band, output size and matrices.

    ``pairs`` as ``pair_similarities`` gives them. Acquisitions without exactly sixteen pairs, with too few that
    pass the gates, or without a band that the region of interest covers, give no row.
    """
    whole = pairs.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") == FRAMES).select(group)
    at = rotation_center(F.array(*[F.col(c) for c in ("a", "b", "tx", "c", "d", "ty")]))
    candidates = pairs.join(whole, group).where(F.col("reason").isNull() & calibration_reason().isNull()).withColumn("at", at)
    candidates = candidates.where("at is not null").select("*", F.col("at.x").alias("center_x"), F.col("at.y").alias("center_y"))
    centers = robust_center(candidates, group)
    top = round(height * ROI_TOP)
    ray = F.pmod(F.degrees(F.atan2(top + (height - top) / 2 - F.col("y"), width / 2 - F.col("x"))), F.lit(360.0))
    region = centers.select(group, F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(0.0).alias("left"), F.lit(float(top)).alias("top"), F.lit(float(width)).alias("right"), F.lit(float(height)).alias("bottom"), ray.alias("ray"), "accepted", "spread")
    out = region.join(radial_bands(region, group), group).withColumn("radius", F.ceil("outer") + 1)
    zero, one = F.lit(0.0), F.lit(1.0)
    out = out.withColumns({"move_x": F.col("radius") - F.col("cx"), "move_y": F.col("radius") - F.col("cy")})
    matrix = lambda k: F.array(one, zero, k * F.col("move_x"), zero, one, k * F.col("move_y"), zero, zero, one)
    side = (2 * F.col("radius") + 1).cast("int")
    return out.select(group, "cx", "cy", "ray", "inner", "outer", "accepted", "spread", side.alias("output_width"), side.alias("output_height"), matrix(1.0).alias("source_to_calibrated"), matrix(-1.0).alias("calibrated_to_source"))
