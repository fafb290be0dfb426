"""A corpus pipeline: reject, de-duplicate, decontaminate, mask, pack.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gyrelake.llm.common import Scratch, read_table
from gyrelake.llm.decontamination import drop_contaminated
from gyrelake.llm.jaccard_join import keep_one
from gyrelake.llm.packing import pack
from gyrelake.llm.pii import redact_documents
from gyrelake.llm.quality import keep_good
from gyrelake.llm.tokenizers_at import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return keep_good(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a Jaccard similarity of 0.8 or more over five words stays, the one of least id."""
    return keep_one(spark, docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return drop_contaminated(spark, docs, read_table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024."""
    return pack(spark, docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", mask),
    ("best-fit packing", packing),
]

#: The stages are models, alignments and solvers, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(f"stage{k}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
