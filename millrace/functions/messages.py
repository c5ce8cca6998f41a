"""Structured records (an id and named fields) in the public length-delimited wire format: tags, variable-byte numbers, lengths.

    record: 1 id (variable bytes), 2 field (message, repeated)
    field:  1 name (text), 2 value (text)

Numbers have seven bits a byte, lowest first; the high bit tells that another byte follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "id bigint, fields array<struct<name:string,value:string>>"
#: Kinds of a tag: a number, something with a length.
NUMBER, SIZED = 0, 2


def _number(x: int) -> bytes:
    x &= (1 << 64) - 1  # negative numbers as their 64 bits
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def _sized(tag: int, data: bytes) -> bytes:
    return bytes([tag << 3 | SIZED]) + _number(len(data)) + data


def pack(id: int, fields: list[tuple[str, str | None]]) -> bytes:
    """A record as bytes; a field whose value is null has a name only."""
    body = b"".join(_sized(2, _sized(1, n.encode()) + (b"" if v is None else _sized(2, v.encode()))) for n, v in fields)
    return bytes([1 << 3 | NUMBER]) + _number(id) + body


def _parts(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        tag = number()
        if tag & 7 == NUMBER:
            yield tag >> 3, number()
        elif tag & 7 == SIZED:
            n = number()
            if at + n > len(data):
                raise IndexError
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise IndexError


def unpack(data: bytes) -> tuple[int | None, list[tuple[str | None, str | None]]] | None:
    """The record, unknown parts left out; None for bytes that are none."""
    id, fields = None, []
    try:
        for tag, part in _parts(data):
            if tag == 1 and isinstance(part, int):
                id = part - (1 << 64) if part >> 63 else part
            elif tag == 2 and isinstance(part, bytes):
                inner = {t: p.decode() for t, p in _parts(part) if isinstance(p, bytes)}
                fields.append((inner.get(1), inner.get(2)))
    except (IndexError, UnicodeDecodeError):
        return None
    return id, fields


def to_message(id: Column, fields: Column) -> Column:
    """Binary of a record; null where the id or the fields are null."""

    @F.pandas_udf(T.BinaryType())
    def run(ids: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if i is None or pd.isna(i) or f is None else pack(int(i), [(x["name"], x["value"]) for x in f]) for i, f in zip(ids, lists)], dtype=object)

    return run(id, fields)


def from_message(data: Column) -> Column:
    """struct<id, fields> of a binary; null parts for null and for bytes that are no record."""

    @F.pandas_udf(RECORD)
    def run(messages: pd.Series) -> pd.DataFrame:
        found = [None if m is None else unpack(bytes(m)) for m in messages]
        ids = pd.array([None if r is None else r[0] for r in found], dtype="Int64")
        return pd.DataFrame({"id": ids, "fields": pd.Series([None if r is None else [{"name": n, "value": v} for n, v in r[1]] for r in found], dtype=object)})

    return run(data)
