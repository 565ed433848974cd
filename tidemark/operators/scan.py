"""Projection, predicates, limits, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SchemaMismatch(ValueError):
    """A requested column does not exist."""


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns in the order asked for, repeats allowed; only these are read from the files."""
    if missing := [n for n in names if n not in df.columns]:
        raise SchemaMismatch(f"no such columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def project_features(df: DataFrame, features: list[str], key: str = "entity_id", ts: str = "timestamp_ns", version: str = "version") -> DataFrame:
    """Key, time and version, then the features asked for; the fixed columns cannot be asked for as features."""
    if fixed := {key, ts, version} & set(features):
        raise SchemaMismatch(f"not features: {sorted(fixed)}")
    return project(df, [key, ts, version, *features])


def equals(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def in_range(col: Column, low=None, high=None) -> Column:
    """Both ends included; an open end is None."""
    out = F.lit(True)
    if low is not None:
        out = out & (col >= F.lit(low))
    if high is not None:
        out = out & (col <= F.lit(high))
    return out


def half_open(col: Column, start, end) -> Column:
    return (col >= F.lit(start)) & (col < F.lit(end))


def of_type(df: DataFrame, type_id: int, column: str = "type_id") -> DataFrame:
    """Type 0 asks for all."""
    return df if type_id == 0 else df.filter(F.col(column) == type_id)


def authorised(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns; an empty list allows all."""
    return df.select(*[c for c in df.columns if not allowed or c in allowed])


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows of a file scan ordered by file and place in the file."""
    return df.orderBy(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def typed_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """One column, read as what it is; asking for another type is an error, nothing is cast."""
    column = project(df, [name])
    if column.dtypes[0][1] != kind:
        raise SchemaMismatch(f"{name} is {column.dtypes[0][1]}, not {kind}")
    return column


def with_row_group(spark, path: str) -> DataFrame:
    """Rows of all files with file, row_index (in the file) and row_group.

    The row groups' places come from the footers; their table has a row a file and is joined by the file's name.
    """
    from ..sources.footers import row_group_places

    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    places = row_group_places(spark, path).groupBy(plain("file").alias("file")).agg(F.sort_array(F.collect_list("first_row")).alias("starts"))
    rows = spark.read.parquet(path).select("*", plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row_index"))
    return rows.join(places, "file").withColumn("row_group", F.size(F.filter("starts", lambda s: s <= F.col("row_index"))) - 1).drop("starts")


def row_group(spark, path: str, number: int) -> DataFrame:
    """Rows of one row group of every file."""
    return with_row_group(spark, path).filter(F.col("row_group") == number)


def by_row_index(spark, path: str, order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows with row_index, their place in the whole table from 0, to be addressed by it.

    The table's order is that of ``order``, nulls last; rows equal in it, or all rows without one, stand by file and place
    in the file. No task holds the table: places come from a sort by range.
    """
    from .aggregates import with_rank

    rows = spark.read.parquet(path)
    key = [x for c in order or [] for x in (F.col(c).isNull(), F.col(c))] + [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    key = [c.alias(f"k{i}") for i, c in enumerate(key)]
    placed = with_rank(rows.select(F.struct(*key).alias("key"), F.struct(*(columns or rows.columns)).alias("row")), "key")
    return placed.select((F.col("rank") - 1).alias("row_index"), "row.*")


def first_rows(df: DataFrame, n: int = 50, order: list[str] | None = None) -> DataFrame:
    """The first n rows in a stated order: a per-task top-n, not a sort of the table."""
    return (df.orderBy(*order) if order else df).limit(n)


def at_rows(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows at the wanted places (row_index)."""
    return df.join(wanted.select("row_index").distinct(), "row_index", "left_semi")


def union_files(spark, paths: list[str], strict: bool = True) -> DataFrame:
    """Rows of all files; unless strict, missing and damaged files are passed over."""
    reader = spark.read
    if not strict:
        reader = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return reader.parquet(*paths)
