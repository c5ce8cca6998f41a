"""Integer codecs: array<bigint> of 32-bit numbers to binary and back, in Arrow batches.

Every codec keeps `decode(encode(x)) == x`. Variable bytes and the words of Simple9 and Simple16 are the
published ones, heads and the other layouts this engine's own; in storage Parquet's
delta encodings serve the same end, these exist for exchange and for size comparisons.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BITS = 28


def vbyte_last(xs: list[int]) -> bytes:
    """Seven bits a byte, highest first; the last byte of a number has its high bit set."""
    out = bytearray()
    for x in xs:
        part = [x & 127 | 128]
        while x := x >> 7:
            part.append(x & 127)
        out += bytes(reversed(part))
    return bytes(out)


def vbyte_last_decode(data: bytes) -> list[int]:
    out, x = [], 0
    for b in data:
        x = x << 7 | b & 127
        if b & 128:
            out.append(x)
            x = 0
    return out


def vbyte_more(xs: list[int]) -> bytes:
    """Seven bits a byte, highest first; the low bit tells whether another byte follows."""
    out = bytearray()
    for x in xs:
        groups = max(1, -(-x.bit_length() // 7))
        out += bytes((x >> 7 * g & 127) << 1 | (g > 0) for g in reversed(range(groups)))
    return bytes(out)


def vbyte_more_decode(data: bytes) -> list[int]:
    out, x = [], 0
    for b in data:
        x = x << 7 | b >> 1
        if not b & 1:
            out.append(x)
            x = 0
    return out


def _pack_bits(parts: list[tuple[int, int]]) -> bytes:
    """(value, width) pairs as one bit string, first part lowest."""
    out, acc, at = bytearray(), 0, 0
    for value, width in parts:
        acc |= value << at
        at += width
        if at >= 512:  # the number in hand stays short, whatever the length of the list
            out += (acc & (1 << 512) - 1).to_bytes(64, "little")
            acc, at = acc >> 512, at - 512
            while at >= 512:
                out += (acc & (1 << 512) - 1).to_bytes(64, "little")
                acc, at = acc >> 512, at - 512
    return bytes(out) + acc.to_bytes((at + 7) // 8, "little")


def rice(xs: list[int]) -> bytes:
    """Quotient in unary, remainder in k bits, k from the mean; a head holds k and the count."""
    k = max(0, (sum(xs) // len(xs)).bit_length() - 1) if xs else 0
    k = max(k, max((x.bit_length() for x in xs), default=0) - 12)  # bounds the unary part
    parts = []
    for x in xs:
        q = x >> k
        parts += [((1 << q) - 1, q + 1), (x & (1 << k) - 1, k)]
    return bytes([k]) + len(xs).to_bytes(4, "little") + _pack_bits(parts)


def rice_decode(data: bytes) -> list[int]:
    k, n = data[0], int.from_bytes(data[1:5], "little")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=5), bitorder="little")
    zeros = np.flatnonzero(bits == 0)
    powers = 1 << np.arange(k, dtype=np.int64)
    out, at = [], 0
    for _ in range(n):
        stop = int(zeros[np.searchsorted(zeros, at)])
        out.append((stop - at << k) + int(bits[stop + 1 : stop + 1 + k] @ powers))
        at = stop + 1 + k
    return out


def frame(xs: list[int], kept: float = 0.9) -> bytes:
    """Numbers in the width that holds `kept` of them; the high bits of the others follow with their places."""
    widths = sorted(x.bit_length() for x in xs)
    b = widths[max(0, int(len(xs) * kept) - 1)] if xs else 0
    odd = [(i, x >> b) for i, x in enumerate(xs) if x >> b]
    return bytes([b]) + len(xs).to_bytes(4, "little") + _pack_bits([(x & (1 << b) - 1, b) for x in xs]) + vbyte_more([v for pair in odd for v in pair])


def frame_decode(data: bytes) -> list[int]:
    b, n = data[0], int.from_bytes(data[1:5], "little")
    end = 5 + (n * b + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, end - 5, 5), count=n * b, bitorder="little").reshape(n, b)
    out = (bits @ (1 << np.arange(b, dtype=np.int64))).tolist()
    rest = vbyte_more_decode(data[end:])
    for i, high in zip(rest[::2], rest[1::2], strict=True):
        out[i] |= high << b
    return out


def _selector_codec(layouts: list[list[int]]) -> tuple[Callable, Callable]:
    """Words of a selector in the high 4 bits and 28 data bits, first number lowest; a layout lists the widths of a word's numbers.

    The words are the published ones. Before them stand the counts of numbers and of words, after them
    the numbers from 2^28 on with their places, which a word can't hold.
    """

    def encode(xs: list[int]) -> bytes:
        large = [(i, x) for i, x in enumerate(xs) if x >> WORD_BITS]
        small = [0 if x >> WORD_BITS else x for x in xs]
        out, at = bytearray(), 0
        while at < len(small):
            for selector, widths in enumerate(layouts):
                chunk = small[at : at + len(widths)]
                if all(x.bit_length() <= w for x, w in zip(chunk, widths)):
                    break
            word, shift = selector << WORD_BITS, 0
            for x, w in zip(chunk, widths):
                word |= x << shift
                shift += w
            out += word.to_bytes(4, "little")
            at += len(chunk)
        head = len(xs).to_bytes(4, "little") + (len(out) // 4).to_bytes(4, "little")
        return head + bytes(out) + vbyte_more([v for pair in large for v in pair])

    def decode(data: bytes) -> list[int]:
        n, words = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
        out: list[int] = []
        for k in range(words):
            word = int.from_bytes(data[8 + 4 * k : 12 + 4 * k], "little")
            shift = 0
            for w in layouts[word >> WORD_BITS]:
                out.append(word >> shift & (1 << w) - 1)
                shift += w
        out = out[:n]
        rest = vbyte_more_decode(data[8 + 4 * words :])
        for i, x in zip(rest[::2], rest[1::2], strict=True):
            out[i] = x
        return out

    return encode, decode


# Widths of the numbers in a word of Simple9 and of Simple16, by selector, as published.
SIMPLE9 = [[1] * 28, [2] * 14, [3] * 9, [4] * 7, [5] * 5, [7] * 4, [9] * 3, [14] * 2, [28]]
SIMPLE16 = [
    [1] * 28,
    [2] * 7 + [1] * 14,
    [1] * 7 + [2] * 7 + [1] * 7,
    [1] * 14 + [2] * 7,
    [2] * 14,
    [4] + [3] * 8,
    [3] + [4] * 4 + [3] * 3,
    [4] * 7,
    [5] * 4 + [4] * 2,
    [4] * 2 + [5] * 4,
    [6] * 3 + [5] * 2,
    [5] * 2 + [6] * 3,
    [7] * 4,
    [10] + [9] * 2,
    [14] * 2,
    [28],
]

simple9, simple9_decode = _selector_codec(SIMPLE9)
simple16, simple16_decode = _selector_codec(SIMPLE16)

CODECS: dict[str, tuple[Callable[[list[int]], bytes], Callable[[bytes], list[int]]]] = {
    "vbyte": (vbyte_last, vbyte_last_decode),
    "vbyte_more": (vbyte_more, vbyte_more_decode),
    "rice": (rice, rice_decode),
    "frame": (frame, frame_decode),
    "simple9": (simple9, simple9_decode),
    "simple16": (simple16, simple16_decode),
}


def encode(numbers: Column, codec: str) -> Column:
    """Binary of an array of numbers from 0 to 2^32 - 1; null stays null."""
    to_bytes = CODECS[codec][0]

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else to_bytes([int(x) for x in a]))

    return run(numbers)


def decode(data: Column, codec: str) -> Column:
    """The numbers of a binary that encode() made; null stays null."""
    to_numbers = CODECS[codec][1]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else to_numbers(bytes(b)))

    return run(data)


def vbyte_size(x: Column) -> Column:
    """Bytes that a number takes in variable-byte form, as an expression."""
    return F.when(x < 1 << 7, 1).when(x < 1 << 14, 2).when(x < 1 << 21, 3).when(x < 1 << 28, 4).otherwise(5)
