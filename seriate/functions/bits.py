"""Integer codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    """0, -1, 1, -2 ... as 0, 1, 2, 3 ..., for all 64-bit values."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("bigint"))))


def varint_length(z: Column) -> Column:
    """Bytes of a non-negative value in groups of 7 bits (a negative one counts as unsigned)."""
    out = F.when(z < 0, 10)
    for n in range(1, 9):
        out = out.when(z < 1 << 7 * n, n)
    return out.otherwise(9)


def float_floordiv(a: Column, b: Column) -> Column:
    """Floor division of floats by way of the exact remainder, so 1.0 by 0.1 is 9."""
    return F.rint((a - F.pmod(a, b)) / b)
