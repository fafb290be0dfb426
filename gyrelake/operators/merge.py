"""Greedy merge of overlapping boxes of one frame and class.

The order decides: the best box absorbs what overlaps it, grows to the union and is compared again,
until a pass changes nothing; only then the next begins. This is no transitive closure, and a
group cannot be divided by overlap, since a grown box may reach boxes that no member touched.
Groups are (frame, class), whose size is bounded by what a detector finds on one frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gyrelake.operators.grouping import sorted_groups

BOX = ["x1", "y1", "x2", "y2"]


def score(a: tuple, b: tuple) -> float:
    """max(IoU, intersection over the smaller box)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both, one, two = w * h, (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    return max(both / (one + two - both), both / min(one, two))


def greedy(boxes: list[tuple], threshold: float) -> list[tuple]:
    """(x1, y1, x2, y2, conf, slices) merged in the order given."""
    waiting, out = list(boxes), []
    while waiting:
        current, waiting = waiting[0], waiting[1:]
        changed = True
        while changed:
            changed, apart = False, []
            for other in waiting:
                if score(current, other) >= threshold:
                    current = (min(current[0], other[0]), min(current[1], other[1]), max(current[2], other[2]), max(current[3], other[3]), max(current[4], other[4]), current[5] | other[5])
                    changed = True
                else:
                    apart.append(other)
            waiting = apart
        out.append(current)
    return out


def merge_boxes(detections: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Merged boxes with the greatest confidence and the sorted set of slices, for each group of ``keys``."""

    def work(key: tuple, rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda r: (-r[1], *r[2:], r[0]))
        merged = greedy([(*r[2:], r[1], frozenset([r[0]])) for r in rows], threshold)
        return [(*key, *m[:5], sorted(m[5])) for m in sorted(merged, key=lambda m: (m[0], m[1], -m[4]))]

    types = ", ".join(f"{k} {detections.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, x1 double, y1 double, x2 double, y2 double, conf double, slices array<int>"
    return sorted_groups(detections.select(*keys, "slice_index", "conf", *BOX), keys, work, schema)
