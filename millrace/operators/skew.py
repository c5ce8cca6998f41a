"""What is known of a key before rows are shuffled on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyProfile:
    """rows: rows with a non-null key; keys: distinct keys; hot: keys that would fill a task by themselves."""

    rows: int
    keys: int
    hot: tuple

    def salt(self, key: Column, by: Column, ways: int) -> Column:
        """A small integer that splits the rows of hot keys by `by`; 0 for all other keys."""
        if not self.hot:
            return F.lit(0)
        return F.when(key.isin(*self.hot), F.pmod(F.xxhash64(by), F.lit(ways)).cast("int")).otherwise(0)


def profile_key(df: DataFrame, key: str) -> KeyProfile:
    """Count rows and keys, and find the hot keys, with map-side combine; a second pass only where there are any.

    A key is hot when it holds more than one 2P-th of all rows, P being the number of shuffle
    partitions. At most 2P keys can, so the list that reaches the driver is bounded by the
    cluster's own setting, whatever the size of the table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    rows, keys, most = counts.agg(F.sum("n_rows"), F.count(F.lit(1)), F.max("n_rows")).first()
    if not keys or most * 2 * parts <= rows:
        return KeyProfile(rows or 0, keys, ())
    hot = counts.filter(F.col("n_rows") * (2 * parts) > rows).select(key).orderBy(key).collect()
    return KeyProfile(rows, keys, tuple(r[0] for r in hot))
