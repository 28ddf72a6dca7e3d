"""Corpus preparation: good documents, without copies, near copies and
benchmark text, as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfspark.llm import decontaminate, exact_dedup, near_dup, quality, queries, tokens
from perfspark.runtime import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field does not reject."""
    labels = queries.table(spark, sf_dir, "labels")
    model = quality.trained(docs, labels.where(queries.fold("doc_id", 3) != 1))
    return quality.good_documents(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of close fingerprints."""
    return near_dup.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, ids."""
    rows = tokens.round_trip(docs, queries.vocabulary_path(), with_ids=True)
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("bpe", token_ids),
]

#: Neither the classifier nor the fingerprints can be written in SQL; the tests
#: compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
