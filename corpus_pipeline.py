"""From documents to packed sequences: filter, drop near copies, drop repeats, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import jaccard, packing, quality, scratch, substrings, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, _labels(spark, sf_dir), F.col("source"), F.concat_ws("/", "source", "lang"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar keeps."""
    return toxicity.keep_clean(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles at a similarity of 0.8."""
    return jaccard.keep_one(docs, 5, 80)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that an earlier one holds."""
    return substrings.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return packing.pack(scratch.table(packing.pieces(docs), "pieces"))


STAGES = [("quality", good), ("toxicity", clean), ("jaccard", distinct), ("suffixes", unrepeated), ("packing", packed)]

#: SQL can express neither the learned stages nor the packing; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
