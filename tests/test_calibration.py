import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrelake.operators import calibration, projective, registration

KIND = "acq int, source_frame int, target_frame int, part string, sx double, sy double, tx double, ty double"


@pytest.mark.parametrize("share", [0.0, 0.2, 0.4, 0.6])
def test_consensus_recovers_planted_outliers(share):
    rng = np.random.default_rng(int(share * 10))
    s = rng.uniform(0, 1000, 200) + 1j * rng.uniform(0, 800, 200)
    a, b = 0.9 * np.exp(-0.4j), 30 - 12j
    t = a * s + b + rng.normal(0, 0.2, 200) + 1j * rng.normal(0, 0.2, 200)
    bad = rng.random(200) < share
    t[bad] += rng.uniform(20, 400, bad.sum()) * np.exp(2j * np.pi * rng.random(bad.sum()))
    got = calibration.consensus(s, t, 7)
    assert (got[2] == ~bad).all()
    want = calibration.fit_similarity(s[~bad], t[~bad])
    assert abs(got[0] - want[0]) < 1e-12 and abs(got[1] - want[1]) < 1e-8


def test_consensus_of_degenerate_points():
    one = np.full(5, 3 + 4j)
    assert calibration.consensus(one, one, 1) is None
    assert calibration.consensus(np.zeros(0, complex), np.zeros(0, complex), 1) is None
    assert calibration.consensus(np.array([1 + 0j]), np.array([1 + 0j]), 1) is None
    assert calibration.consensus(np.array([0j, 10 + 0j]), np.array([5j, 10 + 5j]), 1)[2].all()


def turned(acq, frame, n, rng, center=(800.0, -1500.0), off=0.0):
    """Points of a frame and where a turn by -22.5 degrees puts them in the next one."""
    x = rng.uniform(0, 1600, n) + 1j * rng.uniform(0, 1200, n)
    c = complex(*center)
    y = c + (x - c) * np.exp(-1j * np.radians(22.5))
    rows = []
    for k, (p, q) in enumerate(zip(x, y, strict=True)):
        q += off * (k % 5 < 2) * (70 + 13 * k) if k % 4 else 0
        rows.append((acq, frame, frame % 16 + 1, "held" if k % 4 == 0 else "fit", *map(float, (p.real, p.imag, q.real, q.imag))))
    return rows


def test_pairs_and_calibration(spark):
    rng = np.random.default_rng(2)
    rows = [r for f in range(1, 17) for r in turned(1, f, 60, rng, off=1.0)] + [r for f in range(1, 16) for r in turned(2, f, 60, rng)]
    rows += [(3, f, f % 16 + 1, "fit", 1.0, 1.0, 2.0, 2.0) for f in range(1, 17)] + [(1, 1, 2, "fit", None, 1.0, 1.0, 1.0), (1, 1, 2, "fit", float("nan"), 1.0, 1.0, 1.0)]
    pairs = calibration.pair_similarities(spark.createDataFrame(rows, KIND).repartition(5)).cache()
    found = {(r.acq, r.source_frame): r for r in pairs.collect()}
    assert len(found) == 16 + 15 + 16
    for f in range(1, 17):
        r = found[1, f]
        assert abs(r.angle_degrees + 22.5) < 1e-9 and abs(r.scale - 1) < 1e-12 and r.residual_px < 1e-6 and r.inlier_count == sum(k % 4 > 0 and not (k % 5 < 2) for k in range(60))
        assert found[3, f].reason == calibration.FAILED and found[3, f].a is None
    (out,) = calibration.calibrate(pairs, 1600, 1200).collect()
    assert out.acq == 1 and abs(out.cx - 800) < 1e-6 and abs(out.cy + 1500) < 1e-6 and out.accepted == 16
    radius = out.outer + 1
    assert out.output_width == 2 * radius + 1 and abs(out.ray - 90) < 1e-6
    assert abs(out.source_to_calibrated[2] - (radius - 800)) < 1e-6 and abs(out.calibrated_to_source[5] + radius + 1500) < 1e-6
    near, far = (216 + 1500) / np.cos(np.radians(11.25)), 1200 + 1500
    assert out.inner == int(np.ceil(near + 2)) and out.outer in (far - 2, far - 3)  # the sums end beside a whole number
    pairs.unpersist()


def planted(rng, wild=0.0):
    m = np.tile(np.eye(3), (16, 1, 1))
    for k in range(1, 16):
        a = 0.02 * k
        m[k] = [[np.cos(a), -np.sin(a), 9 * k + wild * rng.normal()], [np.sin(a), np.cos(a), -4 * k], [2e-6 * k, -1e-6 * k, 1]]
    return m


def seen(acq, poses, rng, n=30, noise=0.0):
    rows = []
    for s in range(16):
        q = np.c_[rng.uniform(0, 1600, n), rng.uniform(0, 1200, n)]
        a, b = (registration.projective(np.linalg.inv(poses[f]), q) + rng.normal(0, noise, q.shape) for f in (s, (s + 1) % 16))
        rows += [(acq, s + 1, (s + 1) % 16 + 1, "held" if k % 3 == 0 else "fit", *map(float, (*a[k], *b[k]))) for k in range(n)]
    return rows


def test_derivatives():
    rng = np.random.default_rng(0)
    m, p = np.eye(3) + rng.normal(0, 0.05, (3, 3)), rng.uniform(-0.5, 0.5, (4, 2))
    m[2, 2] = 1
    _, d = projective.mapped(m, p)
    for cell in range(8):
        moved = m.copy()
        moved.ravel()[cell] += 1e-6
        assert np.allclose((projective.mapped(moved, p)[0] - projective.mapped(m, p)[0]) / 1e-6, d[:, :, cell], atol=1e-5)


def test_projective_rings(spark):
    rng = np.random.default_rng(3)
    poses = {1: planted(rng), 2: planted(rng, 1.0), 3: planted(rng)}
    rows = seen(1, poses[1], rng) + seen(2, poses[2], rng, noise=0.05) + seen(3, poses[3], rng, noise=3.0)
    rows += [r for r in seen(4, poses[1], rng) if not (r[1] == 7 and r[3] == "fit")]  # a pair without fit points
    rows += [r for r in seen(5, poses[1], rng) if not (r[1] == 16 and r[3] == "held")]  # a pair without held points
    rows += [(6, s + 1, (s + 1) % 16 + 1, "fit", 1.0, 1.0, 1.0, 1.0) for s in range(16) for _ in range(9)]  # one point again and again
    rows += [(1, 3, 9, "fit", 0.0, 0.0, 0.0, 0.0), (1, 3, 4, "fit", None, 0.0, 0.0, 0.0), (1, 3, 4, "other", 0.0, 0.0, 0.0, 0.0)]
    out = {r.acq: r for r in projective.projective_reconstructions(spark.createDataFrame(rows, KIND).repartition(4), 1600.0, 1200.0).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6}
    assert out[1].passed and out[1].solved and np.abs(np.array(out[1].poses).reshape(16, 3, 3) - poses[1]).max() < 1e-5 and out[1].most_px < 1e-6
    assert out[2].passed and out[2].median_px < 0.2 and len(out[2].pairs) == 16 and out[2].pairs[15].closes
    grid = np.array([[0, 0], [1600, 0], [800, 600], [1600, 1200.0]])
    for k in range(16):
        assert np.abs(registration.projective(np.array(out[2].poses[k]).reshape(3, 3), grid) - registration.projective(poses[2][k], grid)).max() < 2
    assert not out[3].passed and out[3].solved and any("median" in r for r in out[3].reasons)
    assert not out[4].passed and not out[4].poses and out[4].reasons == ["7->8: insufficient fit evidence"]
    assert not out[5].passed and out[5].solved and out[5].reasons == ["16->1: insufficient held-out evidence"] and out[5].pairs[15].median_px is None
    assert not out[6].passed
    few = projective.projective_reconstructions(spark.createDataFrame(rows, KIND).where("acq = 2"), 1600.0, 1200.0, projective.Limits(evaluations=2)).first()
    assert not few.passed and not few.solved and few.reasons[-1] == "the solver used up its evaluations"
    assert projective.projective_reconstructions(spark.createDataFrame([], KIND), 1600.0, 1200.0).where(F.col("acq") > 0).collect() == []


def test_solution_is_a_least_squares_minimum():
    """No small step in any cell lowers the cost that the solver ends with."""
    rng = np.random.default_rng(5)
    rows = seen(1, planted(rng), rng, noise=0.3)
    fit = [np.array([r[4:] for r in rows if r[1] == s and r[3] == "fit"]) for s in range(1, 17)]
    flat = lambda p: p / 1600 - [0.5, 1200 / 3200]
    pairs = [(s, (s + 1) % 16, flat(p[:, :2]), flat(p[:, 2:])) for s, p in enumerate(fit)]
    norm = projective.normal_form(1600, 1200)
    start = np.concatenate([(p / p[2, 2]).ravel()[:8] for p in (norm @ m @ np.linalg.inv(norm) for m in planted(rng)[1:])])
    x, cost, _, done = projective.solve(pairs, start, 1600, 2000)
    assert done
    for k in range(len(x)):
        for step in (1e-5, -1e-5):
            moved = x.copy()
            moved[k] += step
            assert projective.equations(moved, pairs, 1600)[0] >= cost * (1 - 1e-9)


def test_a_homography_of_many_points_takes_memory_in_proportion():
    import tracemalloc

    m = np.array([[1.1, 0.05, 3], [-0.02, 0.9, 7], [1e-4, -2e-4, 1]])
    for n in (4, 5, 3000):
        a = np.random.default_rng(n).uniform(-20, 20, (n, 2))
        tracemalloc.start()
        got = registration.fit_homography(a, registration.projective(m, a))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(got, m, atol=1e-8)
        assert peak < 20e6  # 288 MB for 3,000 points where the left side is square
