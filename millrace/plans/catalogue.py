"""All queries of the engine."""

from millrace.plans import records, relational, series, texts  # noqa: F401
from millrace.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
