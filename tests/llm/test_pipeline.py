from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gyrelake.llm import decontamination, pii
from gyrelake.llm.common import Scratch
from tests.llm.test_jaccard import brute_sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, then what each stage kept, every one written and read again."""
    scratch, docs = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.write(f"s{k}", stage(spark, docs, SF))
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_near_duplicates_keep_the_least_of_each_group(stages):
    before, after = texts(stages[1]), texts(stages[2])
    sets = {d: brute_sets(t, 5) for d, t in before.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and both * 100 >= 80 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    groups = defaultdict(list)
    for d in ids:
        groups[find(d)].append(d)
    assert set(after) == set(groups)


def test_decontamination_and_masks(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after, masked = texts(stages[2]), texts(stages[3]), texts(stages[4])
    flat = lambda t: " ".join(t.lower().split())
    assert not [d for d, t in after.items() if any(flat(x) in flat(t) for _, x in items)]
    index = decontamination.Index(items)
    assert all(index.matches(before[d]) for d in set(before) - set(after))
    assert masked == {d: pii.redact(t) for d, t in after.items()}


def test_packing_is_whole(stages):
    rows = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert rows.where("n > 1024 or n <> end").isEmpty()
    assert {r.doc_id for r in stages[5].select("doc_id").distinct().collect()} == set(texts(stages[4]))
