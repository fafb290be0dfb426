"""The opN_ queries over the driver's tables, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gyrelake.llm.ball_kmeans import ball_kmeans
from gyrelake.llm.common import read_table
from gyrelake.llm.decontamination import contamination
from gyrelake.llm.hash_forest import forest_search
from gyrelake.llm.jaccard_join import near_duplicates
from gyrelake.llm.language import identify
from gyrelake.llm.language_model import score
from gyrelake.llm.licenses import license_report, production_templates
from gyrelake.llm.packing import pack
from gyrelake.llm.pii import pii_digest
from gyrelake.llm.quality import quality_scores
from gyrelake.llm.resampling import resample
from gyrelake.llm.token_counts import count_tokens
from gyrelake.llm.tokenizers_at import tokenizer_path
from gyrelake.llm.topk import top_k


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(read_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"), words=3, percent=90)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(production_templates(), "license_id string, text string")
    return license_report(spark, read_table(spark, sf_dir, "documents"), templates)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, read_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, read_table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, read_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(spark, read_table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_search(spark, read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_approximate_neighbours": op13_approximate_neighbours,
}


def kmeans_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every round as two tables: each vector's nearest centroid, then the floored means."""
    steps = [
        f"""rows as materialized (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256e0 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        )""",
        f"""c0 as materialized (
            select * from (select cast(row_number() over (order by sha256('2:' || vec_id)) - 1 as integer) as c, v from rows) where c < {k}
        )""",
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} as materialized (
            select vec_id, v, c, d from (
                select *, row_number() over (partition by vec_id order by d, c) as n
                from (
                    select r.vec_id, r.v, m.c, cast(list_sum(list_transform(list_zip(r.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d
                    from rows r cross join c{t} m
                )
            ) where n = 1
        )"""
        )
        if t < rounds:
            steps.append(
                f"""c{t + 1} as materialized (
            select o.c, coalesce(m.v, o.v) as v
            from c{t} o left join (
                select c, list((s - ((s % n) + n) % n) // n order by pos) as v
                from (
                    select c, pos, cast(sum(x) as bigint) as s, count(*) as n
                    from (select c, unnest(v) as x, generate_subscripts(v, 1) as pos from a{t})
                    group by c, pos
                ) group by c
            ) m on o.c = m.c
        )"""
            )
    return f"""
        with {", ".join(steps)}
        select a.vec_id, a.c as cluster, a.d as distance,
            cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,
            cast(sum(a.d) over () as bigint) as inertia,
            sha256(array_to_string(m.v, ',')) as centroid_sha256
        from a{rounds} a join c{rounds} m on a.c = m.c
    """


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": kmeans_sql(),
    "op9_exact_top_k": """
        with rows as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256e0 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
            from rows q join rows c on q.vec_id <> c.vec_id
            where q.vec_id % 50 = 0
        ), ranked as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 5
    """,
}
