"""Queries opN_<name> over whole tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, pipeline
from .byte_bpe import round_trip
from .covertree import similar_vectors
from .divergence import source_divergence
from .fingerprint import edit_report
from .language import fitted, identified
from .lattice import lattice_scores
from .licenses import license_report
from .minhash import near_duplicates
from .mixing import mix
from .negatives import hard_negatives
from .shared import text_batches
from .stream_files import token_report
from .suffix import repeat_report
from .warc import archive_report


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(modulus: int) -> Column:
    """crc32 of the id as text modulo a number; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fitted(docs, F.coalesce(_fold(3) != 1, F.lit(True)))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.coalesce(_fold(7) != 2, F.lit(True))
    return lattice_scores(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), train)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir), ["doc_id"]).drop("copies")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(_documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(_documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_documents(spark, sf_dir)).drop("spans")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return archive_report(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("row")


QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_language_id": op2_language_id,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_token_files": op5_token_files,
    "op6_mixing": op6_mixing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_weighted_sampling": op8_weighted_sampling,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
    "pipeline": pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_cover_tree": """
        with recursive v as (
            select vec_id, label, embedding::double[] as e from embeddings
            where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links as (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
            where list_cosine_similarity(a.e, b.e) >= 0.98
        ),
        reached as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
        counted as (select a, count(*) as n_links from links group by a),
        named as (select a, min(b) as low from reached group by a)
        select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
               vec_id = least(vec_id, coalesce(low, vec_id)) as kept
        from embeddings left join counted on counted.a = vec_id left join named on named.a = vec_id
    """,
    "op3_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op9_suffix_dedup": oracles.REPEATS,
    "op11_source_divergence": oracles.DIVERGENCE,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
    "op13_warc": oracles.ARCHIVES,
}
if pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = pipeline.ORACLE_SQL
