"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ball_tree import top_k
from .common import scratch, table
from .decontaminate import contaminated
from .digest_cache import count_tokens
from .packing import pack_documents
from .pii import find_personal_data
from .quality import quality
from .secret_scan import scan
from .simhash import near_duplicates
from .toxicity import toxicity
from .wavelet import read_documents, write_shards


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", end=2)
    return read_documents(spark, path)


def op3_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_simhash_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, within=3)


def op5_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op7_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end=2, capacity=1024)


def op8_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op10_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", scratch(spark, "token-cache"), limit=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_wavelet_shards": op2_wavelet_shards,
    "op3_attention_mil_quality": op3_attention_mil_quality,
    "op4_simhash_vantage_points": op4_simhash_vantage_points,
    "op5_ball_tree_top_k": op5_ball_tree_top_k,
    "op6_nnpu_toxicity": op6_nnpu_toxicity,
    "op7_residual_packing": op7_residual_packing,
    "op8_semi_markov_pii": op8_semi_markov_pii,
    "op9_markov_secrets": op9_markov_secrets,
    "op10_digest_cache": op10_digest_cache,
}

ORACLE_SQL: dict[str, str] = {
    "op5_ball_tree_top_k": """
        with rows as (
            select row_number() over () as place, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.place as query_place, q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
            from rows q join rows c on c.place <> q.place and len(c.v) = len(q.v) where q.vec_id % 20 = 0
        ), ranked as (
            select query_id, row_number() over (partition by query_place order by score desc, vec_id)::int as rank, vec_id, score from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
}
