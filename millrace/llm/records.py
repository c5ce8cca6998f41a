"""Term counts of the records of a token table, the common input of p1 and p3."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.skew import KeyProfile, profile_key

#: The marks that don't belong to a term, and every blank.
MARKS = ".,?:;()'\"[]<>"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def term_of(token: Column) -> Column:
    """token in lower case without blanks and MARKS at its two ends; null for null and where nothing is left."""
    return F.nullif(F.trim(F.lower(token), F.lit(BLANKS + MARKS)), F.lit(""))


@dataclass(frozen=True)
class Counted:
    """pairs: (*by, term, tf), one row per record and term, all rows of one `by` in one partition.

    by is docno, and salt beside it where records are so hot that their terms were spread.
    """

    pairs: DataFrame
    profile: KeyProfile
    by: tuple[str, ...]

    @property
    def records(self) -> int:
        return self.profile.keys


def counted_pairs(rows: DataFrame, row_id: str = "row_id", record: str = "docno", token: str = "token", tf: str = "tf") -> Counted:
    """Count every term in every record.

    A row counts when its record is not null, tf is above zero and the token has a term. Rows of a
    record with the same row_id and term are one row (the smallest tf holds if they disagree); rows
    without a row_id are rows of their own. Other columns are ignored, whatever their names. An
    empty table gives no pairs.

    One shuffle, on the record, serves the removal of repeated rows, the counts and anything per
    record. The rows of a hot record are spread by term, so no task gets a whole hot record.
    """
    valid = rows.select(
        F.col(row_id).cast("long").alias("row_id"), F.col(record).cast("long").alias("docno"), term_of(F.col(token)).alias("term"), F.col(tf).cast("long").alias("tf")
    ).filter("docno is not null and term is not null and tf > 0")
    profile = profile_key(valid, "docno")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lone = F.when(F.col("row_id").isNull(), F.monotonically_increasing_id())
    by = ("docno", "salt") if profile.hot else ("docno",)
    pairs = (
        valid.withColumns({"salt": profile.salt(F.col("docno"), F.col("term"), parts), "lone": lone})
        .repartition(*by)
        .groupBy(*by, "term", "row_id", "lone")
        .agg(F.min("tf").alias("tf"))
        .groupBy(*by, "term")
        .agg(F.sum("tf").alias("tf"))
    )
    return Counted(pairs, profile, by)


def with_record_totals(counted: Counted) -> DataFrame:
    """pairs with `total`, the count of all terms of the record."""
    own = F.sum("tf").over(Window.partitionBy(*counted.by))
    pairs = counted.pairs.withColumn("total", own)
    if counted.profile.hot:  # their salted parts are summed; at most 2P rows, see profile_key
        hot = counted.pairs.filter(F.col("docno").isin(*counted.profile.hot)).groupBy("docno").agg(F.sum("tf").alias("hot_total"))
        pairs = pairs.join(F.broadcast(hot), "docno", "left").withColumn("total", F.coalesce("hot_total", "total")).drop("hot_total")
    return pairs
