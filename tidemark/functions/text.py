"""Text forms of typed values, lenient parsing, report fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_BYTES = 4096


def as_text(col: Column, kind: T.DataType) -> Column:
    """Text of a value: six decimals for floating point, true/false, lower-case hex for binary."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.format_string("%.6f", col.cast("double"))
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(col))
    return col.cast("string")


def rows_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def lenient_long(text: Column) -> Column:
    """A leading integer counts; else a number is cut to its whole part; else 0."""
    prefix = F.regexp_extract(text, r"^-?\d+", 0).try_cast("long")
    return F.coalesce(prefix, text.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def lenient_double(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^\s*[-+]?(\d+\.?\d*([eE][-+]?\d+)?|\.\d+([eE][-+]?\d+)?)", 0).try_cast("double"), F.lit(0.0))


def lenient_boolean(text: Column) -> Column:
    return F.coalesce(text.isin("true", "TRUE", "True", "1"), F.lit(False))


def iso8601(ns: Column, digits: int = 9) -> Column:
    """UTC time of nanoseconds since 1970, cut to 3, 6 or 9 digits; 0 and less give the epoch with nine."""
    whole = F.try_divide(ns - F.pmod(ns, F.lit(1_000_000_000)), F.lit(1_000_000_000)).cast("long")
    seconds = F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.substring(F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), 1, digits)
    return F.when(ns <= 0, F.lit("1970-01-01T00:00:00.000000000Z")).otherwise(F.concat(seconds, F.lit("."), part, F.lit("Z")))


def cut_field(text: Column) -> Column:
    """At most FIELD_BYTES bytes, then a mark that it was cut."""
    return F.when(F.octet_length(text) <= FIELD_BYTES, text).otherwise(F.concat(F.decode(F.substring(text.cast("binary"), 1, FIELD_BYTES), "UTF-8"), F.lit("...[TRUNCATED]")))


def csv_field(text: Column) -> Column:
    """Quoted if it holds a comma, quote or line end; a quoted field that starts like a formula gets an apostrophe."""
    safe = cut_field(text)
    guard = F.when(safe.rlike(r"^[=+\-@\t\r]"), F.lit("'")).otherwise(F.lit(""))
    return F.when(safe.rlike(r'[,"\n\r]'), F.concat(F.lit('"'), guard, F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


#: What a character becomes inside a JSON string; slashes are escaped too.
JSON_ESCAPES = {chr(c): f"\\u{c:04x}" for c in range(32)} | {"\\": "\\\\", '"': '\\"', "/": "\\/", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_text(text: Column) -> Column:
    """The inside of a JSON string. Texts are looked at character by character only where one must be escaped."""
    safe = cut_field(text)
    known = F.create_map(*[F.lit(x) for pair in JSON_ESCAPES.items() for x in pair])
    escaped = F.array_join(F.transform(F.split(safe, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    return F.when(safe.rlike(r'[\x00-\x1f"\\/]'), escaped).otherwise(safe)


def significant(value: Column, digits: int = 10) -> Column:
    """A number with so many significant digits, the shorter of plain and exponent form as C's %g picks it; NaN and infinities are null."""
    number = value.cast("double")
    shown = F.regexp_replace(F.format_string(f"%.{digits}g", number), r"^(-?\d+)(?:(\.\d*[1-9])0*|\.0*)?(e.*)?$", "$1$2$3")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), F.lit("null")).when(number == 0, F.lit("0")).otherwise(shown)


def label_of(code: Column, labels: dict[int, str], unknown: str = "UNKNOWN") -> Column:
    pairs = [F.lit(x) for k, v in labels.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit(unknown))
