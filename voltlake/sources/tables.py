"""Tables of a data folder as lazily planned DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def located(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the synthetic coordinates that the catalogue's spatial queries use."""
    k = F.col(key)
    return df.withColumn("lon", F.lit(88.0) + ((k * 7919) % 4700).cast("double") / 1000.0).withColumn("lat", F.lit(20.5) + ((k * 104729) % 6200).cast("double") / 1000.0)
