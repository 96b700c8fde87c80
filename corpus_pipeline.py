"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, PII surrogates, mixing to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm.common import small_batches, table, written
from loam.llm.decontaminate import decontaminated
from loam.llm.langid import in_known_language
from loam.llm.mixing import mix_documents
from loam.llm.near import one_of_near_copies
from loam.llm.pii import secret_key, with_surrogates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay."""
    small_batches(spark)
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    small_batches(spark)
    return one_of_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    small_batches(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced by surrogates, under the session's key or one that only this application has."""
    small_batches(spark)
    return with_surrogates(docs, secret_key(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, numbered in ``copy``."""
    small_batches(spark)
    return mix_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: Not expressible in SQL: a trained network, SimHash components and keyed permutations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
