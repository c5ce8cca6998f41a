"""The three-table report: late shipments of early orders of one nation's customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_sum(orders: DataFrame, customer: DataFrame, lineitem: DataFrame, day: str, nation: int) -> DataFrame:
    """(o_orderkey, revenue): per order before `day` by a customer of `nation`, the price of its items shipped after `day`, 0 where there are none."""
    at = F.lit(day).cast("timestamp_ntz")
    buyers = customer.filter(F.col("c_nationkey") == nation).select(F.col("c_custkey").alias("o_custkey"))
    early = orders.filter(F.col("o_orderdate") < at).join(buyers, "o_custkey", "left_semi").select("o_orderkey")
    late = lineitem.filter(F.col("l_shipdate") > at).select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return early.join(late, "o_orderkey", "left").groupBy("o_orderkey").agg(F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("revenue"))


def numbered_items(lineitem: DataFrame) -> DataFrame:
    """lineitem in the order of its ship date with positions; equal rows are numbered in any order."""
    from millrace.operators.scan import with_positions

    return with_positions(lineitem, F.col("l_shipdate").cast("date"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "item_pos")


def left_sum_by_index(orders: DataFrame, customer: DataFrame, items: DataFrame, day: str, nation: int) -> DataFrame:
    """left_sum through a join index of positions. orders has pos, items has item_pos."""
    from millrace.operators.joins import join_index

    at = F.lit(day).cast("timestamp_ntz")
    buyers = customer.filter(F.col("c_nationkey") == nation).select(F.col("c_custkey").alias("o_custkey"))
    early = orders.filter(F.col("o_orderdate") < at).join(buyers, "o_custkey", "left_semi").select("o_orderkey", "pos")
    index = join_index(orders, items, "o_orderkey", "l_orderkey", "pos", "item_pos").filter("pos is not null")
    late = items.filter(F.col("l_shipdate") > at).select("item_pos", "l_extendedprice")
    priced = early.join(index, "pos").join(late, "item_pos").groupBy("pos").agg(F.sum("l_extendedprice").alias("_sum"))
    return early.join(priced, "pos", "left").select("o_orderkey", F.round(F.coalesce("_sum", F.lit(0.0)), 2).alias("revenue"))
