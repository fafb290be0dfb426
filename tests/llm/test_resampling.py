import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from gyrelake.llm import resampling
from gyrelake.llm.common import read_table
from gyrelake.llm.resampling import Tournament, features, resample, slices


def brute_features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return words, [zlib.crc32(f) % 10_000 for f in words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]]


def brute(docs, target):
    """Rows by the contract's formulas, one after another."""
    source, goal = np.zeros(10_000, int), np.zeros(10_000, int)
    for table, counts in ((docs, source), (target, goal)):
        for _, text in table:
            for f in brute_features(text)[1]:
                counts[f] += 1
    s_all, t_all = int(source.sum()), int(goal.sum())
    gain = [math.floor(1000 * math.log((t + 1.0) * (s_all + 10_000.0) / ((s + 1.0) * (t_all + 10_000.0)))) for s, t in zip(source.tolist(), goal.tolist(), strict=True)]
    rows = []
    for doc_id, text in docs:
        words, found = brute_features(text)
        weight = sum(gain[f] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: 25 * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in df.dtypes} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("text", ["", "...", "One two, THREE four", "a" * 50, "x " * 40, "é ü ß \x85 a1B2", "no\x00break\x7fhere"])
@pytest.mark.parametrize("size", [3, 1 << 20])
def test_features(text, size, monkeypatch):
    monkeypatch.setattr(resampling, "slices", lambda data: slices(data, size))
    words, found = brute_features(text)
    got, n = features(text)
    assert n == len(words) and sorted(got.tolist()) == sorted(found)


def test_tournament():
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 7, 16, 33):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 9)).tolist()) for _ in range(k)]
        tree, out = Tournament([iter(r) for r in runs]), []
        while (x := tree.pop()) is not None:
            out.append(x)
        assert out == sorted(sum(runs, []))


def test_small_tables(spark):
    long = "word and the following words of a text " * 3
    docs = [(i, long + f"number{i % 5}") for i in range(60)] + [(3, long), (3, long), (None, long), (70, None), (71, ""), (72, "short text"), (-4, "Größe " * 25)]
    target = [(1, "the following words"), (2, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as `key`", "'x' as rank").repartition(4)
    goal = spark.createDataFrame(target, "item_id long, text string")
    want = brute(docs, target)
    assert rows(resample(spark, frame, goal)) == want
    assert rows(resample(spark, frame, goal, rows_a_range=3)) == want  # many ranges


def test_hot_ties_are_cut(spark):
    text = "one " * 30
    docs = [(1, text)] * 200 + [(i, text) for i in range(2, 30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    goal = spark.createDataFrame([(1, "one one")], "item_id long, text string")
    assert rows(resample(spark, frame, goal, rows_a_range=10)) == brute(docs, [(1, "one one")])


def test_empty_tables(spark):
    docs, goal = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows(resample(spark, docs, goal)) == []
    full = [(i, "a few words here " * 6) for i in range(8)]
    assert rows(resample(spark, spark.createDataFrame(full, "doc_id long, text string"), goal)) == brute(full, [])


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs, goal = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in goal.collect()])
    assert rows(resample(spark, docs, goal, rows_a_range=7)) == want
