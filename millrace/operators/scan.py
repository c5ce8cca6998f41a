"""Scans by predicate, early and late materialised, and positions of rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.predicates import Predicate, conjunction
from millrace.session import ensure_checkpoints


def scan(df: DataFrame, predicates: list[Predicate], columns: list[str]) -> DataFrame:
    """Rows that meet all predicates; filter and column list reach the Parquet reader."""
    return df.filter(conjunction(*predicates)).select(*columns)


def late_scan(df: DataFrame, key: str, predicates: list[Predicate], columns: list[str]) -> DataFrame:
    """The same in two phases: keys of qualifying rows first, then the payload of these keys only.

    The key must be unique. Worth it when the payload is wide and few rows qualify.
    """
    keys = df.filter(conjunction(*predicates)).select(key)
    return df.select(key, *[c for c in columns if c != key]).join(keys, key, "left_semi").select(*columns)


#: monotonically_increasing_id has the number of the partition above these bits, the row's place in it below.
PLACE_BITS = 33


def with_positions(df: DataFrame, bucket: Column, order: list[str | Column], name: str = "pos") -> DataFrame:
    """Number the rows from 0 in the given order, without bringing them into one task.

    The rows are sorted by range over all tasks and kept so in the shared folder; each row's number
    is its place in its partition plus the rows of the partitions before, of which the driver holds
    one count each. bucket leads the order and must not decrease along it. Rows equal in all of the
    order are numbered in any order.
    """
    ensure_checkpoints(df.sparkSession)
    sort = [bucket, *(F.col(o) if isinstance(o, str) else o for o in order)]
    placed = df.orderBy(*sort).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", PLACE_BITS)
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = dict(zip([r.part for r in counts], accumulate([0, *(r.n for r in counts)])))
    offsets = df.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("_part", "_before", "_at")


def at_positions(df: DataFrame, positions: DataFrame, name: str = "pos") -> DataFrame:
    """The rows at listed positions."""
    return df.join(positions.select(name).distinct(), name, "left_semi")


def intersect_positions(*lists: DataFrame, name: str = "pos") -> DataFrame:
    """Positions that are in every list, each once."""
    first, *rest = [x.select(name) for x in lists]
    for other in rest:
        first = first.intersect(other)
    return first.distinct()
