"""The input tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Tables with long texts, on which work is by the byte.
TEXTS = {"documents", "pages", "conversations"}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; columns and filters reach the scan."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(found) if name in TEXTS else found


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores where its files give fewer tasks (one small file is one task); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
