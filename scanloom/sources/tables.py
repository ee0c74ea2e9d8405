"""The parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the parquet schema is taken as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
