import math

import numpy as np
import pytest

from gyrelake.llm import topk

NAN, INF, LONG = float("nan"), float("inf"), (1 << 63) - 1


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % every == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(q, v)), -LONG - 1), LONG), j) for b, (j, v) in enumerate(ok) if b != a)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def got(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, score double")
    return sorted(map(tuple, topk.top_k(spark, df, **kw).collect()))


@pytest.mark.parametrize("seed,shard,block", [(0, 16384, 8192), (1, 40, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(seed)
    rows = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(40)] + [(50, [0.5] * 8), (None, [1.0] * 8), (900, None), (901, [None] * 8), (902, [NAN] * 8), (903, [INF] * 8), (950, []), (951, [2.0] * 3)]
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0])]) == []
    assert got(spark, [(0, [1.0]), (1, [1.0])]) == [(0, 1, 1, 65536)]
    big = [(i, [2.0**20 + i, -(2.0**20)]) for i in range(4)]
    assert got(spark, big) == brute(big)


@pytest.mark.parametrize("shard", [16384, 60])
def test_huge_finite_components(spark, monkeypatch, shard):
    """Exact in Python's integers; scores beyond a long count as its ends, and such rows tie."""
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    rows += [(50, [1e300, 1.0, 2.0]), (201, [1e300, 0.0, 0.0]), (250, [-1e300, 1e300, 1e-300]), (202, [3e305, -3e305, 0.0]), (203, [1e16, 1e16, -1e16]), (300, [2e9, -2e9, 1.0]), (204, [-2e9, 2e9, 5.0]), (205, [1e30] * 3), (206, [1e30] * 3)]
    rows += [(210 + i, [1e300, 1e300 * (i % 2), 0.0]) for i in range(100)]
    want = sorted((*w[:3], w[3]) for w in brute(rows))
    assert got(spark, rows, "double") == want
    floats = [(i, [float(np.float32(min(max(x, -3e38), 3e38))) for x in v]) for i, v in rows]
    assert got(spark, floats) == brute(floats)


def test_tree_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-300, 300, (700, 16)).astype(float), rng.integers(-300, 300, (20, 16)).astype(float)
    tree = topk.BallTree(x)
    leaves, bounds = tree.bounds(q, [None] * 20)
    assert sum(tree.nodes[n][1] - tree.nodes[n][0] for n in leaves) == 700
    for c, n in enumerate(leaves):
        a, b = tree.nodes[n][:2]
        assert ((x[tree.order[a:b]] @ q.T).max(0) <= bounds[:, c]).all()


@pytest.mark.parametrize("kind,most", [("clusters", 0.5), ("noise", 1.0)])
def test_visited_leaves(kind, most):
    """The share of leaves that branch and bound visits: fewer than half where rows form clusters (0.37 measured)."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4096, 16)) * (0.05 if kind == "clusters" else 1) + (np.repeat(rng.normal(size=(64, 16)), 64, 0) if kind == "clusters" else 0)
    rows = np.floor(256 * x).astype(int)
    shard = topk.Shard(np.arange(4096), np.arange(4096), rows.tolist())
    best = topk.search(shard, shard.x[::50], np.arange(4096)[::50], [None] * 82)
    for j, q in enumerate(rows[::50]):
        scores = sorted((-int(s), i) for i, s in enumerate(rows @ q) if i != 50 * j)[:5]
        assert best.found[j] == scores
    leaves = sum(n[4] < 0 for n in shard.tree.nodes)
    print(kind, best.visits / (82 * leaves))
    assert best.visits <= most * 82 * leaves
