"""Runs of equal values: encoding, decoding, overlap and point look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rle_encode(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, val, start, length): runs of equal values per key in order, start counted from 0. Nulls are equal to nulls."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.select(key, F.col(value).alias("val"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.lag(F.struct(value)).over(w).alias("_last"))
    begins = F.when(F.col("_last").isNull() | ~F.col("_last").eqNullSafe(F.struct(F.col("val").alias(value))), 1).otherwise(0)
    run = F.sum(begins).over(Window.partitionBy(key).orderBy("pos"))
    return numbered.withColumn("_run", run).groupBy(key, "_run").agg(F.first("val").alias("val"), F.min("pos").alias("start"), F.count(F.lit(1)).alias("length")).drop("_run")


def rle_decode(runs: DataFrame, key: str) -> DataFrame:
    """(key, pos, val) of every position of every run."""
    return runs.select(key, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos"), "val")


#: Positions that are looked at together: a key's runs are cut at its multiples, so that no task gets a whole hot key.
CHUNK = 1 << 16


def _chunked(runs: DataFrame, key: str, side: str) -> DataFrame:
    """(key, _chunk, _at, <side>): the runs cut at the borders of chunks; <side> has the run's value, start, and the end in this chunk."""
    end = F.col("start") + F.col("length")
    spread = runs.filter("length > 0").select(key, "val", "start", end.alias("_end"), F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((end - 1) / CHUNK))).alias("_chunk"))
    low, high = F.greatest("start", F.col("_chunk") * CHUNK), F.least("_end", (F.col("_chunk") + 1) * CHUNK)
    return spread.select(key, "_chunk", low.alias("_at"), F.struct(high.alias("end"), "start", "val").alias(side))


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_val, right_val, start, length) where runs of both sides overlap; the runs of each side don't overlap among themselves.

    One pass over the borders in order: an overlap begins where a run begins while one of the other
    side lasts, and ends with the first of both. No run is paired with others than those it meets.
    """
    both = _chunked(left, key, "_l").unionByName(_chunked(right, key, "_r"), allowMissingColumns=True)
    borders = both.groupBy(key, "_chunk", "_at").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    sofar = Window.partitionBy(key, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = borders.select(key, "_at", *[F.last(c, ignorenulls=True).over(sofar).alias(c) for c in ("_l", "_r")])
    met = last.filter(F.col("_l.end") > F.col("_at")).filter(F.col("_r.end") > F.col("_at"))
    parts = met.select(key, "_l", "_r", "_at", (F.least("_l.end", "_r.end") - F.col("_at")).alias("_n"))
    whole = parts.groupBy(key, F.col("_l.start").alias("_ls"), F.col("_r.start").alias("_rs"), F.col("_l.val").alias("left_val"), F.col("_r.val").alias("right_val"))
    return whole.agg(F.min("_at").alias("start"), F.sum("_n").alias("length")).select(key, "left_val", "right_val", "start", "length")


def at_points(runs: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(key, pos, val): value of the run that holds each point (key, pos); points outside all runs give no row, repeated points repeat theirs."""
    asked = points.select(key, F.floor(F.col("pos") / CHUNK).alias("_chunk"), F.col("pos").alias("_at"), F.lit(1).alias("_asked"))
    both = _chunked(runs, key, "_run").unionByName(asked, allowMissingColumns=True)
    # a run that begins at a point comes before it
    sofar = Window.partitionBy(key, "_chunk").orderBy("_at", F.asc_nulls_first("_asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_run", F.last("_run", ignorenulls=True).over(sofar)).filter("_asked = 1").filter(F.col("_run.end") > F.col("_at"))
    return found.select(key, F.col("_at").alias("pos"), F.col("_run.val").alias("val"))
