"""Corpus pipeline: quality rules, exact dedup, n-gram join, PII, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All
but the last return the columns of ``documents``; the last returns one row for each packed
piece. Repeated rows, repeated and null ids, nulls in other columns and empty texts are rows
like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidlog.functions.runtime import written
from braidlog.llm import cdc, ngram_join, packing, pii, quality
from braidlog.llm.queries import TOKENIZER_FILE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    return quality.keep_clean(docs, length_col="n_chars")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return cdc.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, 5, (80, 100), repeats=False)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms of the same format, under the session's key."""
    return pii.pseudonymise(docs, pii.session_key(spark), length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024."""
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER_FILE), encoding="utf-8") as source:
        return packing.pack(docs, source.read())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("packing", pack),
]
#: SQL cannot express the Feistel rounds or the packing plan; the tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
