"""Reading the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logmill.session import spread


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A test table; wide spreads it over all cores if it is a small file."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if wide else df
