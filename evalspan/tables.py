"""Readers of the parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .runtime import ship


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``directory/name.parquet``, a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")
