"""Vector arithmetic and quantization over array columns; sums in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda a, x: a + x)


def _double(col: Column) -> Column:
    return F.transform(col, lambda x: x.cast("double"))


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def l2_distance_sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def sum_of_squares(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """A vector of zeros stays."""
    return F.get(F.transform(F.array(F.sqrt(sum_of_squares(a))), lambda n: F.when(n == 0, _double(a)).otherwise(F.transform(a, lambda x: x.cast("double") / n))), F.lit(0))


def finite_range(df: DataFrame, column: str) -> DataFrame:
    """One row (lo, hi) over all finite elements; a partial minimum an input row comes first."""
    x = F.filter(_double(F.col(column)), lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.array_min(x).alias("lo"), F.array_max(x).alias("hi")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def scale_symmetric(lo: Column, hi: Column, levels: int = 127) -> Column:
    m = F.greatest(F.abs(lo), F.abs(hi))
    return F.when(m == 0, F.lit(1.0)).otherwise(m / levels)


def quantize_int8(a: Column, scale: Column) -> Column:
    """-127 .. 127, halves to even."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / scale))).cast("int"))


def quantize_uint8(a: Column, scale: Column, zero: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint((x.cast("double") - zero) / scale))).cast("int"))


def quantize_int4(a: Column, scale: Column) -> Column:
    """Binary, two values a byte, -7 .. 7 as two's complement nibbles; even places take the high nibble."""
    q = F.transform(a, lambda x: F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.rint(x.cast("double") / scale))).cast("int"))
    nibble = F.transform(q, lambda v: F.lower(F.substring(F.lpad(F.hex(v.bitwiseAND(F.lit(15))), 2, "0"), 2, 1)))
    text = F.array_join(nibble, "")
    return F.unhex(F.when(F.size(a) % 2 == 1, F.concat(text, F.lit("0"))).otherwise(text))


def dequantize(q: Column, scale: Column, zero: Column | None = None) -> Column:
    return F.transform(q, lambda x: x * scale + (zero if zero is not None else F.lit(0.0)))


def dequantize_int4(packed: Column, size: Column, scale: Column) -> Column:
    text = F.hex(packed)
    value = lambda i: F.conv(F.substr(text, i, F.lit(1)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.when(value(i) > 7, value(i) - 16).otherwise(value(i)) * scale)


#: Schemes of quantization and their greatest level: fixed values.
SCHEMES = {"int8": 127, "uint8": 255, "int4": 7}


def params_of(lo: Column, hi: Column, scheme: str) -> tuple[Column, Column]:
    """Scale and zero point of a scheme for a range of values."""
    if scheme == "uint8":
        return F.when(hi == lo, F.lit(1.0)).otherwise((hi - lo) / SCHEMES[scheme]), lo
    return scale_symmetric(lo, hi, SCHEMES[scheme]), F.lit(0.0)


def quantize(a: Column, scheme: str, scale: Column, zero: Column | None = None) -> Column:
    """Binary codes of a vector by the scheme's name: a byte a value, or half of one for int4."""
    if scheme == "int4":
        return quantize_int4(a, scale)
    if scheme not in SCHEMES:
        raise ValueError(f"no such scheme: {scheme}")
    q = quantize_uint8(a, scale, zero) if scheme == "uint8" else quantize_int8(a, scale)
    return F.unhex(F.array_join(F.transform(q, lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(255))), 2, "0")), ""))


def dequantize_bytes(packed: Column, scheme: str, scale: Column, zero: Column, size: Column) -> Column:
    if scheme == "int4":
        return dequantize_int4(packed, size, scale)
    text = F.hex(packed)
    code = lambda i: F.conv(F.substr(text, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
    signed = (lambda v: v) if scheme == "uint8" else (lambda v: F.when(v > 127, v - 256).otherwise(v))
    return F.transform(F.sequence(F.lit(1), size), lambda i: signed(code(i)) * scale + zero)


def quantize_batch(df: DataFrame, column: str, scheme: str, out: str = "codes") -> DataFrame:
    """``df`` with the codes of ``column`` and the parameters (scale, zero_point, dimension) of its whole range."""
    r = finite_range(df, column)
    scale, zero = params_of(F.col("lo"), F.col("hi"), scheme)
    params = r.select(scale.alias("scale"), zero.alias("zero_point"))
    both = df.join(F.broadcast(params), F.lit(True))  # one row is broadcast
    return both.withColumns({out: quantize(F.col(column), scheme, F.col("scale"), F.col("zero_point")), "dimension": F.size(column)})


def quantization_params(scheme: str, scale: Column, zero: Column, dimension: Column) -> Column:
    return F.concat(F.lit(f"scheme={scheme};scale="), scale.cast("string"), F.lit(";zero_point="), zero.cast("string"), F.lit(";dimension="), dimension.cast("string"))


def parse_quantization_params(text: Column) -> Column:
    return F.str_to_map(text, F.lit(";"), F.lit("="))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def to_half(a: pd.Series) -> pd.Series:
    """Half-precision bit patterns, round to nearest even."""
    return a.map(lambda x: None if x is None else np.asarray(x, "float32").astype("float16").view("uint16").astype("int32"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else np.asarray(x, "int32").astype("uint16").view("float16").astype("float32"))


def slice_rows(tensor: Column, row_size: int, first: int, count: int) -> Column:
    """Rows first .. first + count - 1 of a flat row-major tensor."""
    return F.slice(tensor, first * row_size + 1, count * row_size)


def reshape(tensor: Column, row_size: int) -> Column:
    """Rows of a flat tensor; null if the size does not divide."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(tensor) / row_size - 1).cast("int")), lambda i: F.slice(tensor, (i * row_size + 1).cast("int"), row_size))
    return F.when((F.size(tensor) % row_size == 0) & (F.size(tensor) > 0), rows)


def assemble(*cols: Column | tuple[Column, str]) -> Column:
    """One row of a tensor from numeric columns and, as (column, 'array'), vectors."""
    return F.concat(*[_double(c[0]) if isinstance(c, tuple) else F.array(c.cast("double")) for c in cols])
