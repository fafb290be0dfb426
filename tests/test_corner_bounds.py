import pyarrow as pa
from pyspark.sql import functions as F

from gyrelake.operators import projection as p


def test_bounds_of_a_batch():
    """One call gives a batch's bounds; nulls, infinity and NaN as in Spark's least and greatest."""
    rows = [(1, 0, 2, 0, 1, 3, 0, 0, 1, 0, 0, 4, 5), (1, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 4, 5), (None, 0, 2, 0, 1, 3, 0, 0, 1, 0, 0, 4, 5), (1, 0, 2, 0, 1, 3, 0, 0, 1, None, 0, 4, 5)]
    found, none = p.corner_bounds([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)], 1e-12)
    assert none.tolist() == [False, True, True, False]
    assert [float(v[0]) for v in found] == [2, 3, 6, 8] and [float(v[3]) for v in found] == [6, 3, 6, 8]


def test_projected_bounds_keep_columns(spark):
    boxes = spark.createDataFrame([(1, "a", 0.0, 0.0, 4.0, 5.0), (2, None, 0.0, 0.0, 4.0, 5.0)], "frame int, id string, x1 double, y1 double, x2 double, y2 double")
    frames = spark.range(1, 2).select(F.lit(1).alias("frame"), F.array(*[F.lit(float(v)) for v in (1, 0, 2, 0, 1, 3, 0, 0, 1)]).alias("m"))
    assert [tuple(r) for r in p.projected_bounds(boxes, frames).collect()] == [(1, "a", 0.0, 0.0, 4.0, 5.0, 2.0, 3.0, 6.0, 8.0)]
    assert [(r.frame, r.problem) for r in p.unplaced(boxes, frames).collect()] == [(2, "frame")]
