"""Ordering keys: order-preserving unsigned forms and Morton (Z-order) codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_int32(col: Column) -> Column:
    """0 .. 2^32 - 1 in the order of a signed 32-bit value."""
    return col.cast("long") + F.lit(1 << 31)


def truncate_to_32(col: Column) -> Column:
    """The upper 32 bits of a 64-bit pattern."""
    return F.shiftrightunsigned(col.cast("long"), 32)


def normalize_int64(col: Column) -> Column:
    """Upper 32 bits of a signed 64-bit value in its order; values within 2^32 of each other may share a key."""
    return truncate_to_32(col.cast("long").bitwiseXOR(F.lit(-(1 << 63))))


@F.pandas_udf(T.LongType())
def _double_bits(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy("float64").view("int64"))


@F.pandas_udf(T.LongType())
def _float_bits(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy("float32").view("int32").astype("int64"))


def normalize_double(col: Column) -> Column:
    """Upper 32 bits of the IEEE total order of a double."""
    bits = _double_bits(col)
    return truncate_to_32(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(1 << 63)))))


def normalize_float(col: Column) -> Column:
    """IEEE total order of a float, 0 .. 2^32 - 1."""
    bits = _float_bits(col)
    return F.when(bits < 0, F.lit(-1).cast("long") - bits).otherwise(bits + F.lit(1 << 31))


def normalize_string(col: Column) -> Column:
    """The first four bytes, big-endian, short strings padded with zeros."""
    return F.conv(F.rpad(F.substring(F.hex(col.cast("binary")), 1, 8), 8, "0"), 16, 10).cast("long")


#: Shift and mask of each step that spreads 32 bits over the even places of 64.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(col: Column) -> Column:
    x = col.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(col: Column) -> Column:
    x = col.bitwiseAND(F.lit(0x5555555555555555))
    masks = [0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF]
    for (shift, _), mask in zip(reversed(SPREAD), masks, strict=True):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton_2d(x: Column, y: Column) -> Column:
    """x on the even bits, y on the odd ones, as a signed long; ``unsigned_key`` orders it."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def deinterleave_2d(key: Column) -> tuple[Column, Column]:
    return _gather(key), _gather(F.shiftrightunsigned(key, 1))


def unsigned_key(key: Column) -> Column:
    """A signed long whose order is that of the key read as unsigned."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def morton_nd(*cols: Column) -> Column:
    """Binary key of any number of unsigned 32-bit columns, bits interleaved from the highest, first column first."""
    bits = [F.lpad(F.conv(c.cast("string"), 10, 2), 32, "0") for c in cols]
    mixed = F.concat(*[F.substring(b, i + 1, 1) for i in range(32) for b in bits])
    n = 4 * len(cols)
    return F.unhex(F.concat(*[F.lpad(F.conv(F.substring(mixed, 8 * k + 1, 8), 2, 16), 2, "0") for k in range(n)]))
