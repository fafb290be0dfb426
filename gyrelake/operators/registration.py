"""Pair gates, robust calibration and the ring, pose and projective solvers of one acquisition.

Gates and medians are Columns and grouped aggregates over all acquisitions at once. The solvers see
the 16 edges of one acquisition (a bounded group) and run in numpy inside a grouped map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrelake.functions.geometry import FRAMES, STEP_DEGREES, multiply, ray_interval, registration_confidence


def next_frame(frame: str = "frame", group: str = "acq"):
    """The ring neighbour: the following frame of the acquisition, the first one after the last."""
    w = Window.partitionBy(group).orderBy(frame)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(frame).over(w), F.first(frame).over(whole))


def calibration_reason():
    """The first rule that a pair breaks, null for a candidate."""
    adjacent = F.col("target_frame") == F.col("source_frame") % FRAMES + 1
    reason = F.when(~adjacent, "not_adjacent").when(F.abs(F.col("angle_degrees") + STEP_DEGREES) > 2.0, "angle").when(~F.col("scale").between(0.995, 1.005), "scale")
    return reason.when(F.col("inlier_count") < 5, "inliers").when(F.col("residual_px") > 4.0, "residual")


def assess(pairs: DataFrame, center: tuple[float, float]) -> DataFrame:
    """Pairs with reason (first broken rule), confidence (0 when failed) and correction (null when failed)."""
    deviation = F.abs(F.col("angle_degrees") + STEP_DEGREES)
    away = F.hypot(F.col("center_x") - center[0], F.col("center_y") - center[1])
    confidence = registration_confidence(F.col("inlier_count"), F.col("residual_px"), deviation)
    reason = F.when(deviation > 2.0, "angle").when(~F.col("scale").between(0.995, 1.005), "scale").when(F.col("inlier_count") < 5, "inliers")
    reason = reason.when(F.col("residual_px") > 4.0, "residual").when(away > 150.0, "center").when(confidence < 0.35, "confidence")
    out = pairs.withColumn("reason", reason)
    return out.withColumn("confidence", F.when(F.col("reason").isNull(), confidence).otherwise(0.0)).withColumn("correction", F.when(F.col("reason").isNull(), -F.col("angle_degrees") - STEP_DEGREES))


def robust_center(pairs: DataFrame, group: str = "acq", least: int = 5) -> DataFrame:
    """Median center of each acquisition's candidates, again without outliers; accepted count, limit and spread.

    An outlier is farther than min(250, max(25, three median distances)) from the first median. Groups
    of less than ``least`` candidates, before or after, give no row.
    """
    whole = Window.partitionBy(group)
    first = pairs.withColumns({"mx": F.median("center_x").over(whole), "my": F.median("center_y").over(whole), "m": F.count("*").over(whole)})
    first = first.where(F.col("m") >= least).withColumn("away", F.hypot(F.col("center_x") - F.col("mx"), F.col("center_y") - F.col("my")))
    bound = F.least(F.lit(250.0), F.greatest(F.lit(25.0), 3 * F.median("away").over(whole)))
    kept = first.withColumn("bound", bound).where("away <= bound").withColumns({"fx": F.median("center_x").over(whole), "fy": F.median("center_y").over(whole), "accepted": F.count("*").over(whole)})
    spread = F.max(F.hypot(F.col("center_x") - F.col("fx"), F.col("center_y") - F.col("fy"))).alias("spread")
    return kept.where(F.col("accepted") >= least).groupBy(group).agg(F.first("fx").alias("x"), F.first("fy").alias("y"), F.first("m").alias("candidates"), F.first("accepted").alias("accepted"), F.first("bound").alias("bound"), spread)


RAYS = 4097


def radial_bands(calibrations: DataFrame, group: str = "acq") -> DataFrame:
    """inner and outer whole-pixel radius that every ray of a 22.5 degree sector covers inside the region of interest.

    calibrations: group, cx, cy, left, top, right, bottom, ray (degrees). ``RAYS`` evenly spread rays,
    a margin of two pixels; a sector with a ray that misses, or without a band, gives no row.
    """
    spread = calibrations.select("*", F.explode(F.sequence(F.lit(0), F.lit(RAYS - 1))).alias("k"))
    angle = F.radians(F.col("ray") - STEP_DEGREES / 2 + STEP_DEGREES * F.col("k") / (RAYS - 1))
    hit = ray_interval(*map(F.col, ("cx", "cy", "left", "top", "right", "bottom")), angle)
    seen = spread.withColumn("hit", F.when(hit["far"] > hit["near"], hit)).groupBy(group)
    band = seen.agg(F.count("hit").alias("hits"), F.ceil(F.max("hit.near") + 2).alias("inner"), F.floor(F.min("hit.far") - 2).alias("outer"))
    return band.where((F.col("hits") == RAYS) & (F.col("outer") > F.col("inner"))).select(group, "inner", "outer")


def ring_solutions(source: np.ndarray, target: np.ndarray, correction: np.ndarray, weight: np.ndarray, frames: int = FRAMES, anchor: float = 1000.0) -> np.ndarray:
    """Corrections c of each row's ring with c[target] - c[source] = correction in the least-squares sense, c[1] held at 0."""
    n, m = source.shape
    a, b = np.zeros((n, m + 1, frames)), np.zeros((n, m + 1, 1))
    at, edge, root = np.arange(n)[:, None], np.arange(m)[None], np.sqrt(weight)
    a[at, edge, target - 1] += root
    a[at, edge, source - 1] -= root
    b[:, :-1, 0] = correction * root
    a[:, -1, 0] = anchor
    return (np.linalg.pinv(a) @ b)[..., 0]


def ring_corrections(assessed: DataFrame, radius: float, group: str = "acq", most_degrees: float = 2.0, most_px: float = 4.0) -> DataFrame:
    """frame, correction, residual_px and ok for acquisitions with a full ring of accepted pairs; others give no row.

    ``assessed`` has source_frame, target_frame, correction and confidence; a null or a frame that is
    not 1..16 fails its acquisition. Rings (16 rows each) are solved an Arrow batch at a time.
    """
    known = F.col("source_frame").between(1, FRAMES) & F.col("target_frame").between(1, FRAMES) & F.col("correction").isNotNull() & F.col("confidence").isNotNull()
    full = assessed.groupBy(group).agg(F.count_if(known).alias("good"), F.count("*").alias("n"), F.count_distinct("source_frame").alias("sources"))
    ready = full.where((F.col("good") == FRAMES) & (F.col("n") == FRAMES) & (F.col("sources") == FRAMES)).select(group)
    edge = F.struct("source_frame", "target_frame", F.col("correction").cast("double").alias("correction"), F.col("confidence").cast("double").alias("confidence"))
    rings = assessed.join(ready, group).groupBy(group).agg(F.array_sort(F.collect_list(edge)).alias("e"))
    rings = rings.select(group, *[f"e.{c}" for c in ("source_frame", "target_frame", "correction", "confidence")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s, t, correction, weight = (c.flatten().to_numpy(zero_copy_only=False).reshape(n, FRAMES) for c in batch.columns[1:])
            c = ring_solutions(s, t, correction, weight)
            at = np.arange(n)[:, None]
            gap = np.abs(np.radians(c[at, t - 1] - c[at, s - 1] - correction)) * radius
            ok = (np.abs(c) <= most_degrees).all(1) & (gap <= most_px).all(1)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(n), FRAMES))), *(pa.array(x.ravel()) for x in (s.astype(np.int32), c[at, s - 1], gap, np.repeat(ok, FRAMES)))]
            yield pa.record_batch(columns, [group, "frame", "correction", "residual_px", "ok"])

    return rings.mapInArrow(run, f"{group} {assessed.schema[group].dataType.simpleString()}, frame int, correction double, residual_px double, ok boolean")


def pose_graph(edges: pd.DataFrame, frames: int = FRAMES) -> pd.DataFrame:
    """Similarity poses (angle, scale, tx, ty) of frames 1.. from ring edges (source, target, angle, scale, tx, ty, weight).

    Angles, log scales and translations are three weighted linear problems with frame 1 held at the
    identity; the edge that closes the ring turns a full turn further.
    """
    s, t = edges["source"].to_numpy(int) - 1, edges["target"].to_numpy(int) - 1
    root = np.sqrt(edges["weight"].to_numpy(float))
    turn = -np.radians(edges["angle"].to_numpy(float)) - np.where(t < s, 2 * np.pi, 0.0)
    rows = np.arange(len(edges))

    def solve(values: np.ndarray) -> np.ndarray:
        a, b = np.zeros((len(edges) + 1, frames)), np.zeros(len(edges) + 1)
        a[rows, t] += root
        a[rows, s] -= root
        b[:-1] = values * root
        a[-1, 0] = 1000.0
        return np.linalg.lstsq(a, b, rcond=None)[0]

    angle = solve(turn)
    scale = np.exp(solve(-np.log(edges["scale"].to_numpy(float))))
    c, d = scale[t] * np.cos(angle[t]), scale[t] * np.sin(angle[t])
    x, y = edges["tx"].to_numpy(float), edges["ty"].to_numpy(float)
    # source pose = target pose after the edge map: T[s] - T[t] = L[t] applied to the edge's shift
    return pd.DataFrame({"frame": np.arange(1, frames + 1), "angle": np.degrees(angle), "scale": scale, "tx": solve(-(c * x - d * y)), "ty": solve(-(d * x + c * y))})


def fit_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The direct linear transform of four or more correspondences, normalised, last cell 1."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = p.mean(0)
        k = np.sqrt(2) / max(np.sqrt(((p - middle) ** 2).sum(1)).mean(), 1e-12)
        m = np.array([[k, 0, -k * middle[0]], [0, k, -k * middle[1]], [0, 0, 1]])
        return np.c_[p, np.ones(len(p))] @ m.T, m

    a, ma = normal(source)
    b, mb = normal(target)
    zero = np.zeros_like(a)
    rows = np.r_[np.c_[a, zero, -b[:, :1] * a], np.c_[zero, a, -b[:, 1:2] * a]]
    # without a row and column of the left side for each point; four points alone need the whole right side
    right = np.linalg.svd(rows, full_matrices=len(rows) < 9)[2]
    h = np.linalg.inv(mb) @ right[-1].reshape(3, 3) @ ma
    return h / h[2, 2]


def projective(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ m.T
    return q[:, :2] / q[:, 2:]


def projective_cycle(pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], frames: int, width: float, rounds: int = 60) -> list[np.ndarray]:
    """Matrices of frames 1.. (frame 1 the identity) that make all ring correspondences meet: Levenberg-Marquardt.

    Points are in units of the image width. ``pairs`` maps (source, target) to their points; the
    residual of a pair is the difference of both points on the canvas.
    """
    poses = [np.eye(3)]
    for i in range(1, frames):
        h = fit_homography(pairs[i, i + 1][1] / width, pairs[i, i + 1][0] / width)
        poses.append(poses[-1] @ h)
        poses[-1] = poses[-1] / poses[-1][2, 2]
    x = np.concatenate([p.ravel()[:8] for p in poses[1:]])

    def matrices(x: np.ndarray) -> list[np.ndarray]:
        return [np.eye(3), *(np.append(x[8 * k : 8 * k + 8], 1).reshape(3, 3) for k in range(frames - 1))]

    def residuals(x: np.ndarray) -> np.ndarray:
        m = matrices(x)
        return np.concatenate([(projective(m[s - 1], a / width) - projective(m[t - 1], b / width)).ravel() for (s, t), (a, b) in pairs.items()])

    damp, r = 1e-4, residuals(x)
    for _ in range(rounds):
        j = np.stack([(residuals(x + 1e-7 * e) - r) / 1e-7 for e in np.eye(len(x))], 1)
        g, h = j.T @ r, j.T @ j
        for _ in range(8):
            step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), -g)
            new = residuals(x + step)
            if new @ new < r @ r:
                break
            damp *= 10
        else:
            break
        small = np.abs(step).max() < 1e-12
        x, r, damp = x + step, new, max(damp / 10, 1e-12)
        if small:
            break
    return matrices(x)


def pose_chain(edges: DataFrame, group: str = "acq", frame: str = "frame", matrix: str = "m") -> DataFrame:
    """group, frame and ``m``: the product of the edge matrices before each frame, in order; the first frame's is the identity.

    A group is one ring of frames, so that its fold is short.
    """
    chain = F.array_sort(F.collect_list(F.struct(F.col(frame).alias("frame"), F.col(matrix).alias("m"))))
    start = F.array(*[F.lit(float(k in (0, 4, 8))) for k in range(9)])
    kind = f"array<struct<frame:{edges.schema[frame].dataType.simpleString()},m:array<double>>>"
    step = lambda s, e: F.struct(multiply(s["m"], e["m"]).alias("m"), F.concat(s["out"], F.array(F.struct(e["frame"].alias("frame"), s["m"].alias("m")))).alias("out"))
    poses = F.aggregate(F.col("chain"), F.struct(start.alias("m"), F.array().cast(kind).alias("out")), step)
    return edges.groupBy(group).agg(chain.alias("chain")).select(group, poses.alias("p")).select(group, F.inline("p.out"))


def edge_residuals(edges: DataFrame, width: float, height: float) -> DataFrame:
    """edges with median_px and most_px over five points (corners and middle) of a frame.

    edges: matrices ``source`` and ``target`` (frame to reference) and ``observed`` (source to target);
    a point goes to the reference straight, and over the observed target.
    """
    through = multiply(F.col("target"), F.col("observed"))

    def gap(x: float, y: float) -> Column:
        at = lambda m, k: m[k] * x + m[k + 1] * y + m[k + 2]
        s, t = F.col("source"), F.col("through")
        return F.hypot(at(s, 0) - at(t, 0), at(s, 3) - at(t, 3))

    points = ((0.0, 0.0), (width, 0.0), (width, height), (0.0, height), (width / 2, height / 2))
    gaps = F.array_sort(F.array(*[gap(*p) for p in points]))
    out = edges.withColumn("through", through).withColumn("gaps", gaps)
    return out.withColumns({"median_px": F.col("gaps")[2], "most_px": F.col("gaps")[4]}).drop("through", "gaps")


def conditions(poses: DataFrame, matrix: str = "m", most: float = 1e8) -> DataFrame:
    """poses with the 2-norm condition number of their 3 x 3 matrix (infinite where singular or null) and ``well``."""

    @F.arrow_udf("double")
    def number(m: pa.Array) -> pa.Array:
        out, sizes = np.full(len(m), np.inf), pc.list_value_length(m).to_numpy(zero_copy_only=False)
        nine = np.flatnonzero(sizes == 9)
        if len(nine):
            cells = m.take(pa.array(nine)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3, 3)  # nulls become nan
            whole = np.isfinite(cells).all((1, 2))
            out[nine[whole]] = np.linalg.cond(cells[whole])
        return pa.array(out)

    return poses.withColumn("condition", number(matrix)).withColumn("well", (F.col("condition") < float("inf")) & (F.col("condition") <= most))


def angle_corrections(poses: DataFrame) -> DataFrame:
    """poses (frame 1..16, angle in radians) with ``correction``: degrees beyond the frame's place on the ring."""
    return poses.withColumn("correction", F.degrees("angle") - (F.col("frame") - 1) * STEP_DEGREES)


def nominal_problem() -> Column:
    """The first reason against placing an acquisition by its calibration; the two sides are structs ``manifest`` and ``calibration``."""
    m, c = F.col("manifest"), F.col("calibration")
    differ = lambda a, b: ~m[a].eqNullSafe(c[b])
    out = F.when(differ("acquisition_id", "acquisition_id"), "acquisition").when(differ("side", "side"), "side").when(~c["state"].eqNullSafe("validated"), "state")
    return out.when(differ("expected_width", "input_width"), "width").when(differ("expected_height", "input_height"), "height")
