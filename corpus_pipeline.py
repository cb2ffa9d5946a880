"""A training-data pipeline over documents: language ID, near-dedup, PII surrogates, mixing of sources, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
stages but the last return the columns of documents. A row is known by all its columns: rows that share a doc_id, or have none, are
documents of their own, and of rows that are equal in all columns near-dedup leaves one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.language_id import held_out, learn_languages, recognised
from veilspark.llm.mixing import repeated_documents
from veilspark.llm.near_dedup import one_of_each
from veilspark.llm.pieces import encode_digests
from veilspark.llm.surrogates import masked_documents
from veilspark.llm.tables import written


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without text or letters go. Learnt from the rows that may be learnt from."""
    model = learn_languages(docs.where(~held_out(F.col("doc_id"))))
    return recognised(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more, directly or through others."""
    return one_of_each(docs, size=5, percent=80)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their entities replaced by surrogates. n_chars, if there, follows the text."""
    masked = masked_documents(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("__entities") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document taken twice is two rows."""
    return repeated_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, number of ids, digests of the ids and of the decoded text."""
    return encode_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("mix", mix),
    ("encode", encode),
]

# Near-dedup, surrogates and SentencePiece cannot be written in SQL of reasonable size; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
