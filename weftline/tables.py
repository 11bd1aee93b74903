"""Loading the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import ensure_importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table below sf_dir; column pruning and filters reach the scan."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
