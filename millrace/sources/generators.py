"""Synthetic tables from spark.range: the same rows every time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def users(spark: SparkSession, n: int) -> DataFrame:
    """(user_id, fname, lname, number): MD5 names and the number user_id + 100."""
    i = F.col("id").cast("string")
    return spark.range(n).select(F.col("id").alias("user_id"), F.md5(F.concat(F.lit("f"), i)).alias("fname"), F.md5(F.concat(F.lit("l"), i)).alias("lname"), (F.col("id") + 100).alias("number"))


def lookup_list(spark: SparkSession, n: int, upper: int, seed: int = 7) -> DataFrame:
    """n keys below `upper`, spread by a hash."""
    return spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(upper)).alias("key"))


def repeated_numbers(spark: SparkSession, n: int, repeat: int, cardinality: int, seed: int = 7) -> DataFrame:
    """(pos, value): n pseudo-random values below `cardinality`, each `repeat` times in a row."""
    values = spark.range(n).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(cardinality)).alias("value"))
    return values.select(F.explode(F.sequence(F.col("id") * repeat, F.col("id") * repeat + (repeat - 1))).alias("pos"), "value")
