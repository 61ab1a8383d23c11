"""The corpus pipeline: from raw documents to token ids, in stages that each work on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip
from .language import UNDETERMINED, fitted, identified
from .minhash import near_duplicates
from .mixing import repeated
from .shared import distinct_ids, fresh, keep, text_batches
from .suffix import remove_repeats

#: A document goes when its calibrated score is less than this part of the way from 1 / languages (the score without any evidence) to 1.
LEAST_EVIDENCE = 1 / 30


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language the classifier cannot tell: those without text or letters, and those with a nearly uniform score.

    Where no document is labelled, nothing is learned and letterless texts alone go.
    """
    text_batches(spark)
    model = fitted(docs, F.col("lang").isNotNull())
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    label, score = (fresh(name, docs.columns) for name in ("lang_pred", "lang_score"))
    uniform = 1 / len(model.labels)
    told = (F.col(label) != UNDETERMINED) & (F.col(score) >= uniform + LEAST_EVIDENCE * (1 - uniform))
    return identified(docs, model, names=(label, score)).filter(told).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; every row is a document, whether its id is repeated or null (the largest)."""
    text_batches(spark)
    row = fresh("row", docs.columns)
    rows = distinct_ids(docs, "doc_id", "text", row, nulls_first=False)
    kept = near_duplicates(rows, row).filter("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes that occur earlier are cut out; documents that consist of them go."""
    text_batches(spark)
    return remove_repeats(docs, "doc_id", "text", "n_chars" if "n_chars" in docs.columns else None)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    text_batches(spark)
    return repeated(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    text_batches(spark)
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("repeats", repeats),
    ("mixture", mixture),
    ("byte_bpe", byte_bpe),
]

#: No stage but the mixture could be said in SQL, and that draws by hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
