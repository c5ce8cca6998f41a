"""Rankings: best per group, latest per key, scored sets, merged sorted lists, names with numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scan import with_positions


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group with their rank; Spark keeps only k a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).filter(F.col(rank) <= k)


def latest_per_key(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key, by aggregation: no sort, no window."""
    last = F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])).alias("_last")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"_last._{c}").alias(c) for c in columns])


def set_add(base: DataFrame, rows: DataFrame, key: str, member: str, score: str) -> DataFrame:
    """Scored sets with members added; a member that is there gets the new score, of several new scores the highest."""
    new = rows.groupBy(key, member).agg(F.max(score).alias(score))
    return base.select(key, member, score).join(new.select(key, member), [key, member], "left_anti").unionByName(new)


def set_extremes(df: DataFrame, key: str, member: str, score: str) -> DataFrame:
    """(key, n, best, worst): size of each scored set, its member with the highest and with the lowest score; ties go to the greater and lesser member."""
    pair = F.struct(score, member)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(pair)[member].alias("best"), F.min(pair)[member].alias("worst"))


def merge_sorted(parts: list[DataFrame], *order: str) -> DataFrame:
    """The rows of all lists in one order: a range-partitioned sort."""
    return reduce(DataFrame.unionByName, parts).orderBy(*order)


def by_number_in_name(df: DataFrame, name: str) -> DataFrame:
    """(name, number, prefix, rank): names by the number after their last dash, then by prefix; names without a number come last."""
    number = F.expr(f"try_cast(substring_index({name}, '-', -1) AS BIGINT)")
    prefix = F.when(F.instr(F.col(name), "-") > 0, F.expr(f"substring({name}, 1, length({name}) - length(substring_index({name}, '-', -1)) - 1)")).otherwise(F.col(name))
    rows = df.select(name, number.alias("number"), prefix.alias("prefix"))
    ranked = with_positions(rows, F.asc_nulls_last("number"), [F.col("prefix"), F.col(name)], "rank")
    return ranked.withColumn("rank", F.col("rank") + 1)
