"""Ordered analytics per key: filling, patterns, look-ahead, rates.

"The next row where ..." is always a `last` over the reversed order: frames that end at the
partition's end would be evaluated anew for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_forward(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last non-null value up to each row; leading nulls stay."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def pattern_ranges(df: DataFrame, key: str, order: list[str], trigger: Column, back: Column, ahead: Column) -> DataFrame:
    """(key, start, trigger_pos, end): ranges [start, end) around triggers.

    From a trigger row the range goes back while `back` holds and ahead while `ahead` holds; the
    search goes on after the range's end. All triggers with the same end are one range, that of the
    first of them. A trigger must imply `ahead`. A null condition does not hold.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select(
        key, (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.coalesce(trigger, F.lit(False)).alias("_t"), F.coalesce(back, F.lit(False)).alias("_b"), F.coalesce(ahead, F.lit(False)).alias("_a")
    )
    up, down = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key).orderBy(F.desc("pos"))
    last_stop = F.last(F.when(~F.col("_b"), F.col("pos")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    next_stop = F.last(F.when(~F.col("_a"), F.col("pos")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    bounds = rows.withColumns({"start": F.coalesce(last_stop + 1, F.lit(0).cast("bigint")), "end": F.coalesce(next_stop, size)}).filter("_t")
    return bounds.groupBy(key, "end").agg(F.min_by("start", "pos").alias("start"), F.min("pos").alias("trigger_pos")).select(key, "start", "trigger_pos", "end")


def look_ahead(df: DataFrame, key: str, order: list[str], time: str, trigger: Column, target: Column, seconds: int, id: str) -> DataFrame:
    """(key, id, target_id): for each trigger row the first later row within `seconds` that meets `target`."""
    down = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.last(F.when(target, F.struct(F.col(time).alias("time"), F.col(id).alias("id"))), ignorenulls=True).over(down)
    within = F.col("_hit.time") <= F.col(time) + F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return df.withColumn("_hit", hit).filter(trigger & within).select(key, id, F.col("_hit.id").alias("target_id"))


def tumbling_rate(df: DataFrame, time: str, value: str, seconds: int) -> DataFrame:
    """(window_start, n, per_second, mean_value) of each interval that has rows; batch or stream."""
    w = F.window(time, f"{int(seconds)} seconds")
    return df.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean")).select(
        F.col("w.start").alias("window_start"), "n", F.round(F.col("n") / float(seconds), 6).alias("per_second"), F.round("_mean", 4).alias("mean_value")
    )


def gaps(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, gap): distinct sorted values of each key and the distance to the one before, the first to 0."""
    w = Window.partitionBy(key).orderBy(value)
    return df.select(key, value).distinct().withColumn("gap", F.col(value) - F.lag(value, 1, 0).over(w))


def ungap(df: DataFrame, key: str, order: str, gap: str = "gap") -> DataFrame:
    """(key, value) from gaps in order: the running sum."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(key, F.sum(gap).over(w).alias("value"))
