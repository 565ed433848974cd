"""Parquet footers as tables: file, row group and column chunk statistics. Footers are read by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import store_of

CHUNKS = "file string, row_group int, column_name string, num_rows long, num_values long, null_count long, min_value string, max_value string, compressed_bytes long, uncompressed_bytes long, codec string, encodings string, has_bloom boolean, has_page_index boolean"


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row a column chunk of every file under ``path``."""
    files = spark.read.parquet(path).inputFiles()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for frame in frames:
            for file in frame["file"]:
                store, name = store_of(file)
                with store.open_input_file(name) as handle:
                    meta = pq.ParquetFile(handle).metadata
                rows = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        x = group.column(c)
                        s = x.statistics
                        has = s is not None and s.has_min_max
                        rows.append((file, g, x.path_in_schema, group.num_rows, x.num_values, s.null_count if s is not None and s.has_null_count else None, str(s.min) if has else None, str(s.max) if has else None, x.total_compressed_size, x.total_uncompressed_size, x.compression, ",".join(x.encodings), getattr(x, "bloom_filter_offset", None) is not None, bool(getattr(x, "has_column_index", False))))
                yield pd.DataFrame(rows, columns=[p.split()[0] for p in CHUNKS.split(", ")])

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, min(len(files), 1000)), "file").mapInPandas(read, CHUNKS)


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Rows, row groups, bytes, compression ratio and bytes a row of each file."""
    c = chunks(spark, path)
    groups = c.groupBy("file", "row_group").agg(F.first("num_rows").alias("num_rows"), F.sum("compressed_bytes").alias("compressed"), F.sum("uncompressed_bytes").alias("plain"))
    out = groups.groupBy("file").agg(F.sum("num_rows").alias("num_rows"), F.count("*").alias("row_groups"), F.sum("compressed").alias("compressed_bytes"), F.sum("plain").alias("uncompressed_bytes"))
    return out.withColumn("compression_ratio", F.col("uncompressed_bytes") / F.col("compressed_bytes")).withColumn("bytes_per_row", F.col("compressed_bytes") / F.col("num_rows"))


def column_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Bytes, values and nulls by column over all files and row groups."""
    return chunks(spark, path).groupBy("column_name").agg(F.sum("num_values").alias("num_values"), F.sum("null_count").alias("null_count"), F.sum("compressed_bytes").alias("compressed_bytes"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"))


def row_group_places(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, first_row, rows) of every row group."""
    from pyspark.sql import Window

    groups = chunks(spark, path).groupBy("file", "row_group").agg(F.first("num_rows").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("file").orderBy("row_group")) - F.col("rows")
    return groups.select("file", "row_group", before.alias("first_row"), "rows")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of the files whose footer cannot be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for frame in frames:
            bad = []
            for file in frame["file"]:
                store, name = store_of(file)
                try:
                    with store.open_input_file(name) as handle:
                        pq.ParquetFile(handle)
                except Exception as e:  # whatever is wrong with the file is its reason
                    bad.append((file, type(e).__name__))
            yield pd.DataFrame(bad, columns=["file", "reason"])

    return files.mapInPandas(read, "file string, reason string")
