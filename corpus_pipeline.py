"""Documents to packed training sequences: quality, toxicity, near-duplicates, packing.

Each stage works on all that the one before it kept, and its result is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import common, packing, quality, simhash, toxicity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of docs."""
    return quality.keep(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; it learns from the labels of docs."""
    return toxicity.keep(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", no_near_duplicates), ("packing", packed)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settled(stage(spark, docs, sf_dir), common.scratch(spark, f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
