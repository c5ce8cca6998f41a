"""Tables of a scale-factor folder: one Parquet file or folder per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Make the tables known to spark.sql under their own names."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)
