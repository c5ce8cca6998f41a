"""Key ranges: predicate scans, zone maps and file ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.predicates import KeyRange


def range_scan(df: DataFrame, bounds: KeyRange) -> DataFrame:
    return df.filter(bounds.expression())


def zone_map(df: DataFrame, block: str, key: str) -> DataFrame:
    """(block, low, high, n) of the key in each block."""
    return df.groupBy(block).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"))


def prune(zones: DataFrame, bounds: KeyRange) -> DataFrame:
    """Blocks that can hold a key within the bounds."""
    kept = zones
    if bounds.low is not None:
        kept = kept.filter(F.col("high") >= bounds.low if bounds.low_included else F.col("high") > bounds.low)
    if bounds.high is not None:
        kept = kept.filter(F.col("low") <= bounds.high if bounds.high_included else F.col("low") < bounds.high)
    return kept


def parse_ranges(lines: DataFrame, line: str = "value") -> DataFrame:
    """(key, range<offset, length>) from `key|offset|length` lines; malformed lines are left out."""
    f = F.split(line, r"\|")
    parsed = lines.filter(F.size(f) == 3).select(f[0].alias("key"), F.expr(f"try_cast(get(split({line}, '[|]'), 1) AS BIGINT)").alias("offset"), F.expr(f"try_cast(get(split({line}, '[|]'), 2) AS INT)").alias("length"))
    return parsed.filter("offset is not null and length is not null").select("key", F.struct("offset", "length").alias("range"))
