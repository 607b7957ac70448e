"""Corpus pipeline: documents in, token digests of the cleaned corpus out.

Each stage gets the documents its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, decontaminate, language, linededup, queries, simhash
from cadenza.llm.base import free_prefix, table
from cadenza.session import stage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or unlike any language of the corpus."""
    model, own = language.fit_language(docs), free_prefix(docs)
    found = language.identify(docs, model, own).where(~F.col(f"{own}rejected"))
    return found.drop(*(c for c in found.columns if c.startswith(own)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines from texts and counts n_chars anew; no document is dropped."""
    own = free_prefix(docs)
    found = linededup.remove_boilerplate(docs, prefix=own)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(f"{own}n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return found.drop(*(c for c in found.columns if c.startswith(own)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: one row of digests for each document."""
    return bpe.token_digests(docs, public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: The language model and the fingerprints have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
