"""Parquet folders bucketed by SHA-256 of a key, the same on every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.scalars import hash_bucket


def write_bucketed(df: DataFrame, key: str, n: int, path: str) -> None:
    """One folder per bucket; adaptive execution splits a bucket that a hot key fills."""
    out = df.withColumn("bucket", hash_bucket(F.col(key), n))
    out.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(path)


def read_bucketed(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if buckets is None else df.filter(F.col("bucket").isin(buckets))
