"""Integer hash functions as expressions on BIGINT.

Inputs are 32-bit integers; with up to four parts nothing leaves 64 bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Starts and factors of the hash functions.
START_37, FACTOR_37 = 17, 37
START_SHIFT_ADD = 1315423911
FIRST_FACTOR, NEXT_FACTOR = 63689, 378551
#: The product of the two factors as a signed 32-bit number.
TWO_FACTORS = (FIRST_FACTOR * NEXT_FACTOR + 2**31) % 2**32 - 2**31


def hash37(*parts: Column) -> Column:
    """Start at 17, times 37 plus each part."""
    return reduce(lambda h, p: h * FACTOR_37 + p.cast("bigint"), parts, F.lit(START_37).cast("bigint"))


def shift_add(*parts: Column) -> Column:
    """h xor ((h << 5) + part + (h >> 2)) for each part, from a fixed start."""
    return reduce(lambda h, p: h.bitwiseXOR(F.shiftleft(h, 5) + p.cast("bigint") + F.shiftright(h, 2)), parts, F.lit(START_SHIFT_ADD).cast("bigint"))


def two_factors(first: Column, second: Column) -> Column:
    """first times the next factor plus second; the factor is the product of the two, as a signed 32-bit number."""
    return first.cast("bigint") * TWO_FACTORS + second.cast("bigint")


def shift_xor(*parts: Column) -> Column:
    """(h << 5) xor (h >> 27) xor the lower 16 bits of each part moved right by 0, 8, 16 and 24 bits, from 0."""
    pieces = [F.shiftright(p.cast("int"), 8 * j).bitwiseAND(F.lit(0xFFFF)).cast("bigint") for p in parts for j in range(4)]
    return F.aggregate(F.array(*pieces), F.lit(0).cast("bigint"), lambda h, c: F.shiftleft(h, 5).bitwiseXOR(F.shiftright(h, 27)).bitwiseXOR(c))


def md5_tail(x: Column) -> Column:
    """The last two bytes of the MD5 of the number's four bytes, as a number."""
    digest = F.md5(F.unhex(F.lpad(F.hex(x.cast("bigint")), 8, "0")))
    return F.conv(F.substring(digest, 29, 4), 16, 10).cast("int")
