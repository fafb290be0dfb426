import hashlib

import numpy as np
import pytest

from gyrelake.llm.ball_kmeans import Balls, LONG, ball_kmeans, limbs, packed, unpacked


def brute(rows, k, rounds, dims):
    """The contract's rounds in Python's integers; every vector meets every centroid."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, tuple(int(np.floor(256 * float(x))) for x in v), tuple(v)))
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    centroids = [r[1] for r in sorted(kept, key=name)[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((away(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v, _ in kept:
            members[nearest(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(m) for x in zip(*m, strict=True)) if m else c for m, c in zip(members, centroids, strict=True)]
    out = [(vec_id, *nearest(v)[::-1]) for vec_id, v, _ in kept]
    total = {i: sum(r[2] for r in out if r[1] == i) for i in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    cut = lambda x: min(x, LONG)
    return sorted(((v, c, cut(d), cut(total[c]), cut(sum(total.values())), digest[c]) for v, c, d in out), key=str)


def got(df):
    assert df.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "7 as cluster", "'x' as kind", "1.5 as distance").repartition(3)


@pytest.mark.parametrize("k", [1, 3, 8, 40])
def test_against_brute_force(spark, k):
    rng = np.random.default_rng(k)
    middles = rng.normal(0, 1, (6, 4))
    rows = [(i, [float(x) for x in np.float32(middles[i % 6] + rng.normal(0, 0.1 if i % 2 else 1, 4))]) for i in range(150)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1]), (None, rows[2][1]), (201, None), (202, [1.0]), (203, [0.0, 1.0, None, 0.0]), (204, [float("nan")] * 4), (205, [float("inf")] * 4), (206, [])]
    assert got(ball_kmeans(spark, frame(spark, rows), k, 5, 4)) == brute(rows, k, 5, 4)


def test_ties_and_equal_centroids(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    assert got(ball_kmeans(spark, frame(spark, rows, "float"), 8, 5, 2)) == brute(rows, 8, 5, 2)


def test_huge_components(spark):
    rows = [(i, [1e30 * (i % 4), -1.0, float(i)]) for i in range(20)] + [(50, [3e38, 0.1, 0.2]), (51, [-3e38, 2e9, 0.2]), (52, [1e300, 1e20, 1.0])]
    assert got(ball_kmeans(spark, frame(spark, rows), 5, 5, 3)) == brute(rows, 5, 5, 3)


def test_empty_and_few(spark):
    assert got(ball_kmeans(spark, frame(spark, []))) == []
    assert got(ball_kmeans(spark, frame(spark, [(1, None), (2, [1.0])]))) == []
    rows = [(4, [0.5] * 64)]
    assert got(ball_kmeans(spark, frame(spark, rows))) == brute(rows, 40, 5, 64)


def test_core_and_annuli_are_exact():
    rng = np.random.default_rng(3)
    middles = rng.integers(-200, 200, (12, 5))
    x = (middles[rng.integers(0, 12, 2000)] + rng.integers(-9, 10, (2000, 5))).astype(float)
    each = ((x[:, None, :] - middles[None]) ** 2).sum(2)
    balls = Balls(middles.tolist(), [float("inf")] * 12)
    cluster, distance, _ = balls.nearest(x, rng.integers(0, 12, 2000))  # any guess gives the same
    assert (cluster == each.argmin(1)).all() and (distance == each.min(1)).all()
    radii = [float(distance[cluster == i].max(initial=0)) ** 0.5 for i in range(12)]
    again, _, work = Balls(middles.tolist(), radii).nearest(x, cluster)
    assert (again == cluster).all() and work < 1.5 * len(x)  # nearly all are in stable cores


def test_packing_and_limbs():
    x = np.array([[1.0, -5.0], [32767.0, -32767.0], [1e30, 2.0], [-32768.0, 0.0]])
    assert (unpacked(packed(x), 2) == x).all() and [len(b) for b in packed(x)] == [4, 4, 16, 16]
    for value in (0, -1, 1 << 61, -(1 << 62), 3**200, -(7**150)):
        assert sum(part << (32 * i) for i, part in enumerate(limbs(value))) == value and all(abs(p) < 1 << 63 for p in limbs(value))
