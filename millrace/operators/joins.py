"""Joins: membership chains, inner chains, by position, by a join index, by key list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ensure_checkpoints


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows. It is computed once, for counting and for the join."""
    ensure_checkpoints(df.sparkSession)
    kept = df.checkpoint()
    return F.broadcast(kept) if kept.count() <= rows else kept


def semi_chain(tables: list[DataFrame], keys: list[tuple[str, str]]) -> DataFrame:
    """Rows of the last table whose key is in the table before, that one reduced in the same way.

    keys[i] are the key columns of tables[i] and tables[i + 1]. Set membership: a row comes out once.
    """
    kept = tables[0]
    for table, (left, right) in zip(tables[1:], keys, strict=True):
        kept = table.join(kept.select(F.col(left).alias(right)), right, "left_semi")
    return kept


def inner_chain(tables: list[DataFrame], keys: list[tuple[str, str]], how: str | None = None) -> DataFrame:
    """All matching combinations, duplicates included. how: None lets Catalyst choose, else a join hint."""
    joined = tables[0]
    for table, (left, right) in zip(tables[1:], keys, strict=True):
        side = table.hint(how) if how else table
        joined = joined.join(side, joined[left] == side[right])
    return joined


def by_position(left: DataFrame, right: DataFrame, name: str = "pos") -> DataFrame:
    """Columns of one table put side by side again."""
    return left.join(right, name)


def join_index(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_pos: str, right_pos: str) -> DataFrame:
    """(left_pos, right_pos) of matching rows; right rows without a match have a null left position."""
    l, r = left.select(F.col(left_key).alias("_k"), left_pos), right.select(F.col(right_key).alias("_k"), right_pos)
    return r.join(l, "_k", "left").select(left_pos, right_pos)


def lookup(df: DataFrame, keys: DataFrame, key: str, value: str, missing: object = -1) -> DataFrame:
    """(key, value) of every listed key, `missing` where the table lacks it."""
    return keys.select(key).join(df.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))
