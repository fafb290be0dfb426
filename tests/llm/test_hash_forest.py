import numpy as np
import pyarrow as pa
import pytest

from gyrelake.llm import hash_forest
from gyrelake.llm.common import read_table
from gyrelake.llm.hash_forest import ALL, BITS, Vectors, axes, folded, forest_search, spans, strings


def brute(rows, k=5, every=50):
    """Every query's k nearest of all rows, by plain loops over rows."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in good]).reshape(len(good), width)
    x = x / np.abs(x).max(1, initial=1e-300)[:, None]
    norm = np.sqrt((x * x).sum(1))
    out = []
    for a, (query, _) in enumerate(good):
        if query % every == 0:
            score = x @ x[a] / (norm * norm[a])
            near = sorted((-round(s, 12), good[b][0]) for b, s in enumerate(score) if b != a)[:k]
            out += [(query, rank, vec_id, -s) for rank, (s, vec_id) in enumerate(near, 1)]
    return sorted(out)


def got(df):
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    return sorted((r[0], r[1], r[2], round(r[3], 12)) for r in df.collect())


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "7 as rank", "'x' as key", "1.5 as score", "3 as cls").repartition(3)


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-11)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(220)]
    rows += [(300 + i, rows[50][1]) for i in range(9)] + [(350, rows[50][1]), (350, rows[50][1]), (40, rows[100][1])]  # copies, repeated rows, ties
    rows += [(400, [1.0, 2.0]), (401, [1.0, 2.0, 0.5]), (450, [1e300, 2e300]), (451, [1e-310, 3e-310]), (500, rng.normal(0, 1, 200).tolist())]
    rows += [(550, None), (None, [1.0] * 6), (551, []), (552, [0.0] * 6), (553, [1.0, None]), (554, [float("nan")] * 2), (555, [float("inf"), 1.0])]
    same(got(forest_search(spark, frame(spark, rows))), brute(rows))


def test_empty_and_few(spark):
    assert got(forest_search(spark, frame(spark, []))) == []
    assert got(forest_search(spark, frame(spark, [(0, [1.0, 0.0])]))) == []
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (100, [0.0, -2.0])]
    same(got(forest_search(spark, frame(spark, rows, "float"))), brute([(i, np.float32(v).tolist()) for i, v in rows]))


def test_prefix_ranges():
    rng = np.random.default_rng(2)
    x = hash_forest.unit(rng.normal(0, 1, (300, 64)))
    found = strings(x, axes(2))[:, 0]
    assert found.min() >= 0 and found.max() < 1 << ALL
    found.sort()
    for bits in BITS:
        lo, hi = spans(found, found, bits)
        for i in range(0, 300, 37):
            assert set(range(lo[i], hi[i])) == {j for j in range(300) if found[j] >> (ALL - bits) == found[i] >> (ALL - bits)}


def test_blocks_and_folding():
    column = pa.array([[1.0, 2.0], [3.0], [], [4.0, 5.0, 6.0]])
    v = Vectors(column)
    assert v.block(np.array([0, 1, 3])).tolist() == [[1, 2, 0], [3, 0, 0], [4, 5, 6]]
    assert [r.tolist() for r in v.pieces(1, 4)] == [[1, 2, 3]]
    x = np.ones((2, 130))
    assert folded(x).shape == (2, 64) and (folded(x[:, :10])[:, :10] == 1).all()


@pytest.mark.parametrize("tile", [1 << 17, 4000])
def test_recall_on_embeddings(spark, tile):
    """Searched by prefixes alone (few rows suffice), in trees of several tiles and one tree at a time too."""
    table = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    want = {}
    for query, _, vec_id, _ in brute([(r.vec_id, r.embedding) for r in table.collect()]):
        want.setdefault(query, set()).add(vec_id)
    found = {}
    for query, _, vec_id, _ in got(forest_search(spark, table, enough=400, tile=tile, at_once=1 << 30 if tile > 4000 else 20_000)):
        found.setdefault(query, set()).add(vec_id)
    assert found.keys() == want.keys() and all(len(v) == 5 for v in found.values())
    assert np.mean([len(found[q] & want[q]) / 5 for q in want]) >= 0.9


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, 64)
    rows = [(i, (middle + rng.normal(0, 0.02, 64)).tolist()) for i in range(500)] + [(i, rng.normal(0, 1, 64).tolist()) for i in range(500, 1000)]
    want, have = brute(rows), got(forest_search(spark, frame(spark, rows), enough=200))
    assert len(set(w[:1] + w[2:3] for w in want) & set(h[:1] + h[2:3] for h in have)) >= 0.9 * len(want)
