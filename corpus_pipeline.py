"""A corpus pipeline over ``documents``: quality rules, near-duplicates, decontamination, pseudonyms, mixture.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a frame whose columns are those
of ``documents``; the mixture adds the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulegauge.llm import decontamination, mixing, pii, quality, simhash
from rulegauge.llm.common import stored
from rulegauge.session import apply_defaults


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stand too far from their language's references go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return simhash.keep_one_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by ``benchmark`` go."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by format-preserving pseudonyms."""
    return pii.pseudonymized(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document may come several times or not at all."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
]

#: SQL cannot express SimHash fingerprints; the tests compare the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    apply_defaults(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stored(docs, f"stage-{at + 1}")
    return docs
