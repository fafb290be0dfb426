import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gyrelake.llm import language_model as lm

SF = "/root/testdata/sf0.001"


def brute(rows):
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    c = Counter(w for i, t in rows if crc(i) != 1 for w in tok(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tok(t)
        out.append((i, crc(i) == 1, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return sorted(out, key=str)


def compare(spark, docs, rows):
    got = sorted(map(tuple, lm.score(spark, docs).collect()), key=str)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    return got


def test_base_equals_brute_force_and_model_is_better(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(lm, "HEAD", 100)
    got = compare(spark, docs, rows)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    assert all(g[6] < 0 for g in got)


def test_edges(spark):
    rows = [(1, "A b\tc"), (None, "a B"), (2, None), (2, ""), (3, "a " * 30000), (4, "é É z"), (11, "unseen words only")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    compare(spark, docs, rows)
    assert lm.score(spark, docs.limit(0)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = lm.score(spark, spark.createDataFrame([(only, "x y")], "doc_id long, text string")).collect()
    assert got[0].base_score == 0 and got[0].train_tokens == 0 and got[0].n_known == 0


def test_training_raises_the_likelihood_and_sums_to_one(spark):
    rng = np.random.default_rng(0)
    cell = rng.integers(0, lm.CELLS, 3000)
    cell = cell - cell % lm.CLASSES + (cell // lm.CLASSES // lm.SKIP) % 7
    cells = spark.createDataFrame([(int(c), int(n)) for c, n in zip(cell, rng.integers(1, 9, 3000))], "cell int, n long").repartition(3)
    weights, fits = lm.train(spark, cells)
    assert all(b > a for a, b in zip(fits, fits[1:]))
    assert np.exp(weights.log_probabilities(np.arange(50))).sum(1) == pytest.approx(np.ones(50))


def test_tokens_equal_plain_splitting():
    texts = [None, "", " \t", "  A b\x0b\x1cC \n", "é ÀÉ" + "Y" * 100 + " x\x00y", "a  B\ra"]
    t = lm.tokens_of(lm.pa.array(texts))
    words = t.words.cast(lm.pa.binary()).to_pylist()
    plain = [[*(x or "").encode().lower().split(), b"\n"] for x in texts]
    assert [words[i] for i in t.token] == [w for p in plain for w in p]
    assert t.text.tolist() == [i for i, p in enumerate(plain) for _ in p]
    alone = lm.tokens_of(lm.pa.array(["b\x0b\x1cc"]))  # hashes don't depend on the words beside
    assert set(alone.outcome.tolist()) <= set(t.outcome.tolist())


def test_the_word_factor_knows_the_word_before(spark):
    # both words after x1 and x2 are of one class, so that only the word's own features tell them apart
    a, b = "aaing", next(w + "ing" for w in "bcdefgh" if len(set(lm.codes(lm.pa.array(["aaing", w + "ing"]))[0])) == 2)
    assert len({int(k) // lm.BINS for k in lm.codes(lm.pa.array([a, b]))[0]}) == 1
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(2000, 3000) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    rows = [(i, f"x1 {a}" if k % 2 else f"x2 {b}") for k, i in enumerate(ids)]
    rows += list(zip(held, [f"x1 {a}", f"x2 {a}", f"x2 {b}", f"x1 {b}"]))
    got = {r.doc_id: r.score for r in lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, swapped = got[held[0]] + got[held[2]], got[held[1]] + got[held[3]]
    assert seen > swapped + 1


def test_the_word_factor_is_trained_and_sums_to_one(spark):
    rng = np.random.default_rng(1)
    cell = np.unique(rng.integers(0, 40 * lm.NEAR * lm.OUTCOMES, 3000))
    inner = spark.createDataFrame([(int(c), int(n)) for c, n in zip(cell, rng.integers(1, 9, len(cell)))], "cell int, n long").repartition(3, lm.F.floor(lm.F.col("cell") / (lm.NEAR * lm.OUTCOMES)))
    weights, fits = lm.train_words(spark, inner, rng.uniform(0.5, 9, lm.OUTCOMES))
    assert all(b > a for a, b in zip(fits, fits[1:]))
    sums = np.exp(weights.log_probabilities(np.arange(50))).reshape(50, lm.CLASSES, lm.BINS).sum(2)
    assert sums == pytest.approx(np.ones((50, lm.CLASSES)))
    assert np.abs(weights.before).max() > 0.1 and np.abs(weights.near).max() > 0.01


@pytest.mark.parametrize("factor", ["class", "word"])
def test_what_a_step_sends_to_the_driver_does_not_grow_with_the_partitions(spark, monkeypatch, factor):
    rng = np.random.default_rng(2)
    owner, step, limit = (lm.CLASSES * lm.SKIP, lm.expectations, lm.FEATURES * lm.CLASSES) if factor == "class" else (lm.NEAR * lm.OUTCOMES, lm.word_expectations, lm.WORD_FEATURES * lm.OUTCOMES)
    cell = np.unique(rng.integers(0, lm.CELLS if factor == "class" else lm.INNER, 20000))
    cells = spark.createDataFrame([(int(c), int(n)) for c, n in zip(cell, rng.integers(1, 9, len(cell)))], "cell int, n long")
    weights = lm.Weights() if factor == "class" else lm.WordWeights(rng.uniform(0.5, 9, lm.OUTCOMES))
    sent = []
    kind = type(cells)
    collect, to_arrow = kind.collect, kind.toArrow

    def collected(self):
        rows = collect(self)
        sent.append(sum(len(x) for r in rows for x in r if isinstance(x, bytes | bytearray)))
        return rows

    def arrow(self):
        table = to_arrow(self)
        sent.append(table.nbytes)
        return table

    monkeypatch.setattr(kind, "collect", collected)
    monkeypatch.setattr(kind, "toArrow", arrow)
    found = []
    for partitions in (4, 64):
        sent.clear()
        found.append(step(cells.repartition(partitions, lm.F.floor(lm.F.col("cell") / owner)), weights, spark))
        assert 0 < sum(sent) <= limit * 8 * 1.1  # seen and expected of every feature, four bytes each
    for a, b in zip(*found):
        assert a == pytest.approx(b, rel=1e-5)
