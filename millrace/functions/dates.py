"""Dates as the numbers that column files use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yyyymmdd(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def epoch_day(ts: Column) -> Column:
    return F.unix_date(ts.cast("date"))
