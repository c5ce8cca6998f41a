"""The registry of queries: a key, what it runs, and the SQL it is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can say it."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
