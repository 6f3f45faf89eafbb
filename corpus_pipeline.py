"""A corpus pipeline: quality rules, near-dedup, substring dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
result as Parquet and reads it again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import common, op2_quality, op5_secrets, op6_minhash, op9_trees, op10_packing


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the length of the present text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the cascade rejects go."""
    return op2_quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least id."""
    return op6_minhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word sequences that occur again are cut out; every document stays."""
    return _counted(op9_trees.without_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _counted(op5_secrets.redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 4096 tokens."""
    return op10_packing.packed(docs, op10_packing.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Suffix trees, entropies and a tokenizer's ids are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
        common.dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
