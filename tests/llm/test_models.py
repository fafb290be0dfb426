import zlib

import numpy as np
import pytest

from gyrelake.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(spark, docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    known = [r for r in held if truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(truth[r.doc_id] == r.lang_pred for r in known) >= 0.97 * len(known)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, "the and of this is what", "en", 1) for i in range(30)] + [(100 + i, "der die das und nicht ist", "de", 1) for i in range(30)]
    rows += [(None, "der die das", "de", 1), (None, None, None, 1), (500, None, "en", 1), (501, "123 !!", "en", 1), (502, "", None, 1), (503, "das ist nicht der " * 20000, None, 1), (503, "x", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(spark, docs).collect()}
    assert {(500, "und"), (501, "und"), (502, "und"), (None, "und"), (None, "de"), (503, "de"), (3, "en")} <= got
    assert language.identify(spark, docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language.identify(spark, docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=language.softmax(v)) for v in z])
    assert 0.8 < language.temperature(z, y) < 1.25
    assert 4 < language.temperature(z * 5, y) < 6.2


def test_quality_against_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.quality_scores(spark, docs).collect()}
    assert len(got) == docs.count()
    good = [d for d in label if label[d] == 1]
    bad = [d for d in label if label[d] == 0]
    assert np.mean([got[d].keep for d in good]) >= 0.97
    assert np.mean([1 - got[d].keep for d in bad]) >= 0.95
    kept = quality.keep_good(spark, docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in got if got[d].keep)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "Some plain words here, again.", "c"), (2, "Some plain words here, again.", "c"), (3, "a b " * 50000, "d")], "doc_id long, text string, score string")
    got = quality.quality_scores(spark, docs).collect()
    assert len(got) == 5
    twins = [r.score for r in got if r.doc_id == 2]
    assert twins[0] == twins[1]
    assert quality.quality_scores(spark, docs.limit(0)).collect() == []


def test_em_recovers_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    acc = [0.9, 0.8, 0.7, 0.85]
    codes = np.zeros(20000, int)
    for a in acc:
        right = rng.random(20000) < a
        codes = codes * 3 + np.where(rng.random(20000) < 0.2, 2, np.where(right, truth, ~truth))
    patterns, counts = np.unique(codes, return_counts=True)
    posterior, table = quality.expectation_maximisation(patterns, counts.astype(float), 4)
    label = dict(zip(patterns, posterior))
    assert np.mean([(label[c] >= 0.5) == t for c, t in zip(codes, truth)]) > 0.9
    share = table[:, 1, 1] / (table[:, 1, 1] + table[:, 1, 0])
    assert share == pytest.approx(acc, abs=0.08)
