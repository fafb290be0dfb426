"""Operators that were rebuilt so that no task holds a whole group, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrelake.operators import evidence, projection


@pytest.mark.parametrize("accuracy", [100_000, 50])
def test_percentiles_are_exact(spark, monkeypatch, accuracy):
    """With a coarse sketch too, whose brackets hold a few of the ranks only."""
    monkeypatch.setattr(evidence, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    rows = [(0, float(v)) for v in rng.normal(size=3000)] + [(1, 4.0)] * 500 + [(1, float(v)) for v in rng.integers(0, 9, 300)]
    for k in range(2, 40):  # groups of 1 to 38 values
        rows += [(k, float(v)) for v in rng.integers(0, 5 * k, k - 1)]
    frame = spark.createDataFrame([*rows, (5, None), (77, None)], "pair int, v double").repartition(6)
    shares = {"median": 0.5, "p95": 0.95, "low": 0.03, "all": 1.0, "none": 0.0}
    got = {r["pair"]: r for r in evidence.percentiles(frame, ["pair"], "v", shares).collect()}
    assert set(got) == {p for p, _ in rows}
    for pair, r in got.items():
        values = np.array([v for p, v in rows if p == pair])
        assert r["n"] == len(values) and r["most"] == values.max()
        for name, share in shares.items():
            assert abs(r[name] - np.percentile(values, 100 * share)) < 1e-9, (pair, name, len(values))
    (every,) = evidence.percentiles(frame, [], "v", shares).collect()
    assert abs(every["p95"] - np.percentile([v for _, v in rows], 95)) < 1e-9
    assert evidence.percentiles(frame.where("v > 1e9"), ["pair"], "v", shares).collect() == []


def test_split_and_sample(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(x), float(y), i) for i, (g, x, y) in enumerate(zip(rng.integers(0, 2, 900), rng.integers(-300, 2000, 900), rng.integers(-300, 900, 900), strict=True))] + [(None, 5.0, 5.0, 900), (None, 500.0, 5.0, 901)]
    points = spark.createDataFrame(rows, "pair int, x double, y double, k int").repartition(5)
    split = evidence.spatial_split(points, ["pair"], ["k"])
    assert split.columns == ["pair", "x", "y", "k", "ordinal", "part"]
    got = {r.k: (r.ordinal, r.part) for r in split.collect()}
    for pair in (0, 1, None):
        mine = sorted((y // 256, x // 256, y, x, k) for p, x, y, k in rows if p == pair)
        assert [got[m[-1]] for m in mine] == [(i, "held" if i % 5 == 0 else "fit") for i in range(len(mine))]
    some = evidence.ranked_sample(split.where("pair is not null"), ["pair"], "ordinal", 40)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, evidence.even_sample(split.where("pair is not null"), ["pair"], ["ordinal"], 40).drop("rank").collect()))


def test_wide_runs_meet_strip_by_strip(spark):
    runs = spark.createDataFrame([(1, [(0, 3, 300), (1, 10, 20)]), (2, [(0, 64, 128)]), (3, [(5, 0, 9)])], "id int, runs array<struct<y:int,x1:int,x2:int>>")
    seen = spark.createDataFrame([(x, y, 1) for y in (0, 1) for x in range(0, 400) if x % 100 < 70], "x int, y int, p int")
    got = {r.id: (r.x1, r.y1, r.x2, r.y2, r.area) for r in projection.clip_to_acquired(runs, seen, ["id"]).collect()}
    assert got == {1: (3, 0, 270, 2, 67 + 70 + 70 + 10), 2: (64, 0, 128, 1, 6 + 28)}


def test_predictions_without_a_place(spark):
    frames = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -0.25, 0.0, 1.0])], "frame int, m array<double>")
    rows = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 0.0, 0.0, 4.0, 4.0), (2, 5.0, 0.0, 9.0, 4.0), (3, 0.0, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 1.0, 1.0)], "frame int, x1 double, y1 double, x2 double, y2 double")
    assert sorted((str(r.frame), r.x1, r.problem) for r in projection.unplaced(rows, frames).collect()) == [("2", 0.0, "infinity"), ("3", 0.0, "frame"), ("None", 0.0, "frame")]
    bounds = projection.projected_bounds(rows, frames)
    assert bounds.count() == 3 and bounds.where(F.col("left_px").isNull()).count() == 1
