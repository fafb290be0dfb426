"""Scalar geometry as Column expressions; nothing here leaves whole-stage codegen.

Boxes are (x1, y1, x2, y2); matrices are arrays of nine doubles, row by row. Null inputs give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_degrees(angle: Column) -> Column:
    """The angle in [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def circular_difference(left: Column, right: Column) -> Column:
    return wrap_degrees(left - right)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Common area of two boxes, 0 where they do not overlap."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((width > 0) & (height > 0), width * height).otherwise(0.0)


def overlap_score(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """max(intersection over union, intersection over the smaller area); 0 for disjoint boxes."""
    both = intersection(a, b)
    one, two = area(*a), area(*b)
    return F.when(both > 0, F.greatest(both / (one + two - both), both / F.least(one, two))).otherwise(0.0)


def map_point(m: Column, x: Column, y: Column, gate: float = 1e-12) -> Column:
    """struct(x, y) of a point through a homogeneous matrix; null when it goes to infinity."""
    w = m[6] * x + m[7] * y + m[8]
    at = F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y"))
    return F.when(F.abs(w) > gate, at)


def multiply(a: Column, b: Column) -> Column:
    """The product of two 3 x 3 matrices."""
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def rotation_about(cx: Column, cy: Column, degrees: Column) -> Column:
    """The matrix that turns by an angle about a center."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, cx - c * cx + s * cy, s, c, cy - s * cx - c * cy, zero, zero, one)


def is_inverse(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether a times b is the identity within the tolerance, in every cell."""
    p = multiply(a, b)
    tests = [F.abs(p[k] - float(k in (0, 4, 8))) <= tolerance for k in range(9)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def rotation_center(affine: Column, gate: float = 1e-9) -> Column:
    """struct(x, y): the fixed point of an affine map (a, b, tx, c, d, ty); null for near-identity turns."""
    a, b, tx, c, d, ty = (affine[k] for k in range(6))
    det = (1 - a) * (1 - d) - b * c
    at = F.struct((((1 - d) * tx + b * ty) / det).alias("x"), ((c * tx + (1 - a) * ty) / det).alias("y"))
    return F.when(F.abs(det) >= gate, at)


def registration_confidence(inliers: Column, residual: Column, deviation: Column) -> Column:
    """0.45 for inliers (30 are enough), 0.35 for the residual (4 px is none), 0.20 for the angle (2 degrees is none)."""
    return 0.45 * F.least(F.lit(1.0), inliers / 30.0) + 0.35 * F.greatest(F.lit(0.0), 1 - residual / 4.0) + 0.20 * F.greatest(F.lit(0.0), 1 - deviation / 2.0)


def edge_weight(inliers: Column, residual: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-6), inliers / 50.0)) / F.pow(F.greatest(F.lit(0.5), residual), F.lit(2.0))


def feather(x: Column, y: Column, width: Column, height: Column, most: int = 512) -> Column:
    """The blend weight of a pixel: its distance from the nearest edge, at most ``most``."""
    return F.greatest(F.lit(0), F.least(x + 1, width - x, y + 1, height - y, F.lit(most)))


def ray_interval(cx: Column, cy: Column, left: Column, top: Column, right: Column, bottom: Column, radians: Column) -> Column:
    """struct(near, far): where a ray enters and leaves a rectangle (slab method); null when it misses."""
    dx, dy = F.cos(radians), F.sin(radians)
    inf = float("inf")

    def slab(c: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        a, b = (lo - c) / d, (hi - c) / d
        flat, inside = F.abs(d) < 1e-12, (c >= lo) & (c <= hi)
        return (F.when(flat, F.when(inside, -inf).otherwise(inf)).otherwise(F.least(a, b)), F.when(flat, F.when(inside, inf).otherwise(-inf)).otherwise(F.greatest(a, b)))

    (xn, xf), (yn, yf) = slab(cx, dx, left, right), slab(cy, dy, top, bottom)
    near, far = F.greatest(F.lit(0.0), xn, yn), F.least(xf, yf)
    return F.when(near <= far, F.struct(near.alias("near"), far.alias("far")))


def prediction_id(cls: Column, links: Column) -> Column:
    """A stable id of a class and its (frame, id) evidence links."""
    text = F.concat_ws("|", cls.cast("string"), F.array_join(F.transform(links, lambda x: F.concat_ws(":", x["frame"].cast("string"), x["id"])), "|"))
    return F.concat(F.lit("disc-prediction-"), F.substring(F.sha2(text, 256), 1, 24))


def tile_coefficients(m: Column, x: Column, y: Column) -> Column:
    """The eight coefficients that take a tile's pixels, the tile being at (x, y) of the output, to the source."""
    zero, one = F.lit(0.0), F.lit(1.0)
    moved = multiply(m, F.array(one, zero, x.cast("double"), zero, one, y.cast("double"), zero, zero, one))
    return F.transform(F.slice(moved, 1, 8), lambda v: v / moved[8])


def preview_scale(width: Column, height: Column, most: int) -> Column:
    return F.least(F.lit(1.0), most / F.greatest(width, height))


def disk_estimate(width: Column, height: Column) -> Column:
    """Bytes asked for before a render: five per pixel, a fifth more, and 16 MiB."""
    return F.floor(width * height * 5 * 1.2).cast("long") + (16 << 20)


FULL_TURN, FRAMES = 360.0, 16
STEP_DEGREES = FULL_TURN / FRAMES
TAU = 2 * math.pi
