"""The corpus pipeline: quality classifier, exact dedup, near-dedup, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featlab.llm import exact_dedup, near_copies, packing, pii, quality
from featlab.llm.common import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Candidates by SimHash fingerprints, and by min-hash buckets for what differs in more bits; an exact check of the shingles follows."""
    return near_copies.drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_first_fit(docs)


STAGES = [("quality classifier", good), ("exact dedup", exact), ("simhash near-dedup", near), ("pii", private), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
