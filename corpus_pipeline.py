"""A training-corpus pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages are
written as Parquet and read again, so each has a plan of its own and a lost executor costs no more
than the stage that it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexlake.cluster import scratch
from codexlake.llm import jaccard, packing, quality, toxicity
from codexlake.llm.common import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns; null and empty texts score the model's bias. Without labels all stay."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts, with all their columns; null and empty texts score the model's bias. Without labels all stay."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more; rows without words or id stay. See `jaccard.one_of_each`."""
    return jaccard.one_of_each(docs, 5, 80, 100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece; null and empty texts are one piece of one token. No documents give no rows."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", without_near_duplicates), ("packing", packed)]

#: No SQL: the classifiers' updates run one row after another. tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, one after the other. A stage that keeps nothing hands on an empty table."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
