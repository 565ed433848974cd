"""CSV import with whole-column type inference, and tick files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lenient_boolean, lenient_double, lenient_long
from .wal import TICK


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header: every column is long, else double, else boolean, else string, over all of its rows.

    Empty fields say nothing about the type; a column of empties is long. Short rows are padded, long ones cut, blank
    lines dropped; an empty number becomes 0.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("inferSchema", False).csv(path)
    names = raw.columns
    if not names:
        return raw
    tests = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        filled = x.isNotNull() & (x != "")
        tests += [F.count_if(filled & ~x.rlike(r"^[-+]?\d{1,18}$") & x.try_cast("long").isNull()).alias(f"l{i}"), F.count_if(filled & x.try_cast("double").isNull()).alias(f"d{i}"), F.count_if(filled & ~F.lower(x).isin("true", "false")).alias(f"b{i}")]
    bad = raw.agg(*tests).first()
    out = []
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        if not bad[f"l{i}"]:
            x = lenient_long(F.coalesce(x, F.lit("")))
        elif not bad[f"d{i}"]:
            x = lenient_double(F.coalesce(x, F.lit("")))
        elif not bad[f"b{i}"]:
            x = lenient_boolean(x)
        else:
            x = F.coalesce(x, F.lit(""))
        out.append(x.alias(c))
    return raw.select(*out)


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Tick rows of CSV files, gzipped ones too; rows that do not fit the schema are dropped."""
    return spark.read.schema(TICK).option("header", True).option("mode", "DROPMALFORMED").csv(path).dropna()
