import numpy as np
from pyspark.sql import functions as F

from gyrelake.operators import placement


def ring(acq, change=lambda k, row: row):
    return [r for k in range(16) if (r := change(k, (acq, k + 1, 22.5 * k, f"sha-{k}")))]


def test_the_first_broken_rule_of_a_manifest(spark):
    rows = ring(1) + ring(2, lambda k, r: r if k else None) + ring(3, lambda k, r: (3, 5, *r[2:]) if k == 7 else r) + ring(4, lambda k, r: (4, r[1], 1.0, r[3]) if k == 3 else r)
    rows += ring(5, lambda k, r: (*r[:3], "sha-0")) + ring(6, lambda k, r: (*r[:2], None, r[3]) if k == 2 else r) + ring(7, lambda k, r: (*r[:3], None) if k == 2 else r) + ring(8, lambda k, r: (8, r[1] + 1, *r[2:]))
    frames = spark.createDataFrame(rows, "acq int, position int, angle_degrees double, sha256 string")
    got = {r.acq: r.problem for r in placement.manifest_problems(frames).collect()}
    assert got == {1: None, 2: "count", 3: "positions", 4: "angles", 5: "content", 6: "angles", 7: "content", 8: "positions"}


def test_angle_sets(spark):
    rows = [(1, a) for a in (10.0, -10.0, 370.5)] + [(2, a) for a in (0.0, 360.0, 5.0)] + [(3, a) for a in (1.0, float("nan"), 2.0)] + [(4, 1.0)] + [(5, a) for a in (1.0, None, 3.0)] + [(6, a) for a in (1.0, float("-inf"), 3.0)]
    got = {r.acq: (r.problem, r.angles) for r in placement.angle_sets(spark.createDataFrame(rows, "acq int, angle double"), 3).collect()}
    assert got == {1: (None, [10.0, 10.5, 350.0]), 2: ("unique", None), 3: ("finite", None), 4: ("count", None), 5: ("finite", None), 6: ("finite", None)}


def test_pairing_is_strict(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string"), spark.createDataFrame([(2, 0.5), (3, 0.7)], "k int, m double")
    both, problems = placement.paired(a, b, ["k"])
    assert [tuple(r) for r in both.collect()] == [(2, "y", 0.5)] and sorted(map(tuple, problems.collect())) == [(1, "matrix"), (3, "frame")]


def test_transforms_move_centers_and_undo_each_other(spark):
    frames = spark.createDataFrame(ring(1) + ring(2) + ring(3), "acq int, position int, angle_degrees double, sha256 string")
    centers = spark.createDataFrame([(1, 10.0, -20.0, 300.0, 310.0), (2, 0.0, 0.0, 5.0, 5.0)], "acq int, cx double, cy double, ox double, oy double")
    nominal = placement.nominal_transforms(frames, centers)
    turned = [(a, k + 1, 0.1 * k, a == 1 or k != 4) for a in (1, 2) for k in range(16)]
    corrected = placement.corrected_transforms(nominal, spark.createDataFrame(turned, "acq int, frame int, correction double, ok boolean"))
    for table, more in ((nominal, 0.0), (corrected, 0.1)):
        found = [r for r in table.collect() if r.acq == 1]
        assert len(found) == 16 and {r.acq for r in table.collect()} == ({1, 2} if not more else {1})
        for r in found:
            m, back = np.array(r.source_to_output).reshape(3, 3), np.array(r.output_to_source).reshape(3, 3)
            assert np.allclose(m @ back, np.eye(3), atol=1e-9) and np.allclose(m @ [10, -20, 1], [300, 310, 1])
            assert np.isclose(np.degrees(np.arctan2(m[1, 0], m[0, 0])) % 360, (22.5 + more) * (r.position - 1) % 360)


def test_frames_of_a_run_and_snapshot_ids(spark):
    frames = spark.createDataFrame([("a", 2), ("b", 0), ("a", 0), ("a", 1)], "run_id string, frame_index int")
    assert [r.frame_index for r in placement.frames_of(frames, "a").collect()] == [0, 1, 2] and placement.frames_of(frames, "c").collect() == []
    assert frames.select(placement.snapshot_id(F.col("run_id"), F.col("frame_index"))).first()[0] == "a-r2"
