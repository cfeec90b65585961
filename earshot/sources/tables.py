"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files) below ``folder``."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
