"""Parquet table access by directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One parquet table of the directory ``base``; schema comes from the footers, nothing is inferred from values."""
    return spark.read.parquet(f"{base}/{name}.parquet")
