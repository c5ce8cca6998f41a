"""Comparators, conjunctions and the predicate strings `op(column:type,value)`."""

from __future__ import annotations

import operator
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARATORS = {"EQ": operator.eq, "NE": operator.ne, "GT": operator.gt, "GE": operator.ge, "LT": operator.lt, "LE": operator.le}
SIGNS = {"=": "EQ", "<": "LT", "<=": "LE", ">": "GT", ">=": "GE"}
TYPES = {"int": "int", "integer": "int", "tinyint": "tinyint", "bigint": "bigint", "long": "bigint", "double": "double", "char": "string", "string": "string"}


class Predicate(NamedTuple):
    """column, comparator (a key of COMPARATORS), value, type; a value None means no predicate."""

    column: str
    comparator: str
    value: object
    type: str | None = None

    def expression(self) -> Column:
        if self.value is None or (isinstance(self.value, str) and self.value == "NULL"):
            return F.lit(True)
        value = F.lit(self.value)
        if self.type:
            value = value.cast(TYPES[self.type.lower()])
        return COMPARATORS[self.comparator](F.col(self.column), value)


class KeyRange(NamedTuple):
    """Bounds of a key; None is unbounded."""

    column: str
    type: str
    low: object
    low_included: bool
    high: object
    high_included: bool

    def expression(self) -> Column:
        key = F.col(self.column).cast(self.type)
        tests = []
        if self.low is not None:
            tests.append(key >= self.low if self.low_included else key > self.low)
        if self.high is not None:
            tests.append(key <= self.high if self.high_included else key < self.high)
        return reduce(operator.and_, tests, F.lit(True))


def conjunction(*predicates: Predicate) -> Column:
    """All predicates; Catalyst pushes each of them to the scan."""
    return reduce(operator.and_, (p.expression() for p in predicates), F.lit(True))


def parse_range(text: str) -> KeyRange:
    """`op(column:type,value)` with op one of = < <= > >=, as bounds of the column."""
    m = re.fullmatch(r"\s*(=|<=|>=|<|>)\s*\(\s*(\w+)\s*:\s*(\w+)\s*,\s*(.+?)\s*\)\s*", text)
    if not m or m[3].lower() not in TYPES:
        raise ValueError(f"not a predicate: {text!r}")
    kind = TYPES[m[3].lower()]
    value = float(m[4]) if kind == "double" else m[4] if kind == "string" else int(m[4])
    above = m[1] in ("=", ">", ">=")
    below = m[1] in ("=", "<", "<=")
    return KeyRange(m[2], kind, value if above else None, m[1] != ">", value if below else None, m[1] != "<")
