"""Typed values to big-endian bytes and back, in Arrow batches; null stays null."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: type -> (struct format or None for text and bytes, Spark type)
TYPES = {"boolean": (">?", T.BooleanType()), "int": (">i", T.IntegerType()), "bigint": (">q", T.LongType()), "float": (">f", T.FloatType()), "double": (">d", T.DoubleType()), "string": (None, T.StringType()), "binary": (None, T.BinaryType())}


def to_bytes(value: Column, type: str) -> Column:
    """Numbers and booleans at their fixed width, text as UTF-8."""
    form = TYPES[type][0]
    if form is None:
        return value.cast("binary")

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        whole = type in ("int", "bigint")
        return pd.Series([None if pd.isna(v) else struct.pack(form, int(v) if whole else v) for v in s], dtype=object)

    return run(value)


def from_bytes(data: Column, type: str) -> Column:
    """The value; null for bytes of another width. A boolean is true for any byte above zero."""
    form, kind = TYPES[type]
    if form is None:
        return data.cast(kind)
    width = struct.calcsize(form)

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        values = [None if b is None else bytes(b) for b in s]
        # an object series: a null must not turn integers into doubles
        return pd.Series([(b > b"\x00" if type == "boolean" else struct.unpack(form, b)[0]) if b is not None and len(b) == width else None for b in values], dtype=object)

    return run(data)
