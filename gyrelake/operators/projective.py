"""The joint projective solve of a ring of frames, as an operator: correspondences in, poses and validated pairs out.

Correspondences are rows (acq, source_frame, target_frame, part, sx, sy, tx, ty) of the sixteen neighbour pairs of an
acquisition. Fifteen poses of eight cells (frame 1 is the identity) make the points of both sides of every pair meet,
by Levenberg-Marquardt with exact derivatives over normal equations: a pair touches the blocks of its two frames alone.
Held points then judge each pair. An acquisition's rows are at most what a matcher keeps of sixteen pairs of images;
they come in a sorted stream, one acquisition after another, so that a task holds one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrelake.functions.geometry import FRAMES
from gyrelake.operators.grouping import sorted_groups
from gyrelake.operators.registration import fit_homography

CELLS = 8
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Limits:
    """What an acquisition must keep to."""

    fit_points: int = 8
    held_points: int = 5
    median_px: float = 1.0
    p95_px: float = 1.0
    most_px: float = 1.0
    condition: float = 1e10
    evaluations: int = 2000


def mapped(m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points through a matrix, their derivatives by its first eight cells [point, axis, cell])."""
    q = np.c_[p, np.ones(len(p))]
    w = q @ m[2]
    out = (q @ m[:2].T) / w[:, None]
    d = np.zeros((len(p), 2, CELLS))
    d[:, 0, 0:3] = d[:, 1, 3:6] = q / w[:, None]
    d[:, :, 6:8] = -out[:, :, None] * (p / w[:, None])[:, None, :]
    return out, d


def matrices(x: np.ndarray) -> np.ndarray:
    m = np.tile(np.eye(3), (FRAMES, 1, 1))
    m[1:] = np.c_[x.reshape(-1, CELLS), np.ones(FRAMES - 1)].reshape(-1, 3, 3)
    return m


def equations(x: np.ndarray, pairs: list[tuple[int, int, np.ndarray, np.ndarray]], scale: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(half the sum of squares, gradient, normal matrix) at x; each pair adds to the blocks of its frames."""
    m, n = matrices(x), (FRAMES - 1) * CELLS
    cost, g, h = 0.0, np.zeros(n + CELLS), np.zeros((n + CELLS, n + CELLS))  # frame 1 comes first and is cut off below
    for s, t, a, b in pairs:
        (u, du), (v, dv) = mapped(m[s], a), mapped(m[t], b)
        r = ((u - v) * scale).ravel()
        j = np.concatenate([du, -dv], 2).reshape(len(r), 2 * CELLS) * scale
        at = np.r_[s * CELLS : (s + 1) * CELLS, t * CELLS : (t + 1) * CELLS]
        cost += 0.5 * float(r @ r)
        g[at] += j.T @ r
        h[np.ix_(at, at)] += j.T @ j
    return cost, g[CELLS:], h[CELLS:, CELLS:]


def solve(pairs: list[tuple[int, int, np.ndarray, np.ndarray]], x: np.ndarray, scale: float, most: int) -> tuple[np.ndarray, float, int, bool]:
    """(x, cost, evaluations, whether it ended by its tolerances) from a start, points in units of the width."""
    damp, spent = 1e-4, 1
    cost, g, h = equations(x, pairs, scale)
    while spent < most:
        if np.abs(g).max() <= TOLERANCE:
            return x, cost, spent, True
        weight = np.maximum(np.diag(h), 1e-12)
        try:
            step = np.linalg.solve(h + damp * np.diag(weight), -g)
        except np.linalg.LinAlgError:
            damp *= 10
            spent += 1
            continue
        with np.errstate(all="ignore"):
            now = equations(x + step, pairs, scale)
        spent += 1
        if np.isfinite(now[0]) and now[0] <= cost:
            small = cost - now[0] <= TOLERANCE * cost or np.linalg.norm(step) <= TOLERANCE * (TOLERANCE + np.linalg.norm(x))
            x, damp = x + step, max(damp / 10, 1e-15)
            cost, g, h = now
            if small:
                return x, cost, spent, True
        else:
            damp *= 10
            if damp > 1e20:
                return x, cost, spent, True  # no step lowers the cost
    return x, cost, spent, False


def normal_form(width: float, height: float) -> np.ndarray:
    """Pixels to units of the width about the image's middle."""
    return np.array([[1 / width, 0, -0.5], [0, 1 / width, -height / (2 * width)], [0, 0, 1]])


def reconstruct(points: dict[int, dict[str, np.ndarray]], width: float, height: float, limits: Limits) -> tuple:
    """The row of one acquisition from its points (sx, sy, tx, ty) by source frame and part."""
    no = np.zeros((0, 4))
    fit = [points.get(s, {}).get("fit", no) for s in range(1, FRAMES + 1)]
    held = [points.get(s, {}).get("held", no) for s in range(1, FRAMES + 1)]
    name = [f"{s}->{s % FRAMES + 1}" for s in range(1, FRAMES + 1)]
    if few := [f"{n}: insufficient fit evidence" for n, p in zip(name, fit, strict=True) if len(p) < limits.fit_points]:
        return (False, False, None, 0, None, [], None, None, None, few)
    norm = normal_form(width, height)
    flat = lambda p: p / width - [0.5, height / (2 * width)]
    pairs = [(s, (s + 1) % FRAMES, flat(p[:, :2]), flat(p[:, 2:])) for s, p in enumerate(fit)]
    reasons: list[str] = []
    with np.errstate(all="ignore"):
        poses = [np.eye(3)]
        for _, _, a, b in pairs[:-1]:
            poses.append(poses[-1] @ fit_homography(b, a))
        start = np.concatenate([(p / p[2, 2]).ravel()[:CELLS] for p in poses[1:]])
    if not np.isfinite(start).all():
        return (False, False, None, 0, None, [], None, None, None, ["no finite start: a pair's points are degenerate"])
    x, cost, spent, done = solve(pairs, start, width, limits.evaluations)
    m = matrices(x)
    pixel = np.linalg.inv(norm) @ m @ norm
    pixel /= pixel[:, 2:, 2:]
    for k, p in enumerate(pixel, 1):
        if not np.isfinite(p).all() or not np.linalg.cond(p) <= limits.condition:
            reasons.append(f"frame {k}: projective transform is ill-conditioned")
    judged, all_away = [], []
    for s, p in enumerate(held):
        why, numbers = [], (None, None, None)
        if len(p) < limits.held_points:
            why.append("insufficient held-out evidence")
        else:
            with np.errstate(all="ignore"):
                away = np.linalg.norm(mapped(m[s], flat(p[:, :2]))[0] - mapped(m[(s + 1) % FRAMES], flat(p[:, 2:]))[0], axis=1) * width
            numbers = (float(np.median(away)), float(np.percentile(away, 95)), float(away.max()))
            all_away.append(away)
            for value, most, what in zip(numbers, (limits.median_px, limits.p95_px, limits.most_px), ("median", "95th percentile", "maximum"), strict=True):
                if not value <= most:
                    why.append(f"held-out {what} exceeds the limit")
        judged.append((s + 1, (s + 1) % FRAMES + 1, s + 1 == FRAMES, len(fit[s]), len(p), *numbers, not why, why))
        reasons += [f"{name[s]}: {w}" for w in why]
    if not done:
        reasons.append("the solver used up its evaluations")
    every = np.concatenate(all_away) if all_away else None
    overall = (float(np.median(every)), float(np.percentile(every, 95)), float(every.max())) if every is not None else (None,) * 3
    return (not reasons, done, cost, spent, pixel.reshape(FRAMES, 9).tolist(), judged, *overall, reasons)


PAIR = "struct<source_frame:int,target_frame:int,closes:boolean,fit_count:int,held_count:int,median_px:double,p95_px:double,most_px:double,passed:boolean,reasons:array<string>>"


def projective_reconstructions(correspondences: DataFrame, width: float, height: float, limits: Limits = Limits(), group: str = "acq") -> DataFrame:
    """A row for each acquisition: passed, solved, cost, evaluations, ``poses`` (frame to reference, nine cells each, frame 1 first), ``pairs``, overall medians and reasons.

    Rows that are not a neighbour pair of frames 1..16, and points with a null or non-finite number, are left out; a pair without
    enough points fails its acquisition, and then nothing is solved (``poses`` is null).
    """
    ring = F.col("source_frame").between(1, FRAMES) & (F.col("target_frame") == F.col("source_frame") % FRAMES + 1)
    numbers = [F.col(c).cast("double").alias(c) for c in ("sx", "sy", "tx", "ty")]
    rows = correspondences.where(ring & F.col("part").isin("fit", "held")).select(group, F.col("source_frame").cast("int").alias("source_frame"), "part", *numbers)

    def work(key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        points: dict[int, dict[str, np.ndarray]] = {}
        for (s, part), some in groupby(found, lambda r: r[:2]):
            p = np.array([r[2:] for r in some if None not in r], float).reshape(-1, 4)
            points.setdefault(s, {})[part] = p[np.isfinite(p).all(1)]
        yield (*key, *reconstruct(points, width, height, limits))

    kind = correspondences.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, passed boolean, solved boolean, cost double, evaluations int, poses array<array<double>>, pairs array<{PAIR}>, median_px double, p95_px double, most_px double, reasons array<string>"
    return sorted_groups(rows, [group], work, schema, ("source_frame", "part", "sx", "sy", "tx", "ty"))
