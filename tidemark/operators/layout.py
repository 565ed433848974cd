"""Clustering of files by Z-order, and Parquet write options."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..functions.keys import morton_2d, morton_nd, unsigned_key
from ..sources.tables import store_of


def z_order(df: DataFrame, *normalized: Column, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by the Morton key of normalized (unsigned 32-bit) columns."""
    key = unsigned_key(morton_2d(*normalized)) if len(normalized) == 2 else morton_nd(*normalized)
    keyed = df.withColumn("z_", key)
    dealt = keyed.repartitionByRange(partitions, "z_") if partitions else keyed.repartitionByRange("z_")
    return dealt.sortWithinPartitions("z_").drop("z_")


def rank_normalized(df: DataFrame, column: str, out: str, buckets: int = 1 << 16) -> DataFrame:
    """Adds ``out``: the column's approximate quantile place, 0 .. 2^32 - 1, so any spread of values fills the key."""
    points = df.select(F.percentile_approx(column, [i / 256 for i in range(257)], buckets)).first()[0] or []
    place = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= F.col(column)))
    return df.withColumn(out, (place.cast("long") * F.lit((1 << 32) // 258)))


def parquet_writer(df: DataFrame, codec: str = "zstd", row_group_bytes: int | None = None, max_rows: int | None = None, bloom: dict[str, int] | None = None, dictionary: bool | None = None) -> DataFrameWriter:
    """A writer with codec, row group size, rows a file, Bloom filters (column: expected distinct values) and dictionary use."""
    out = df.write.option("compression", codec)
    if row_group_bytes:
        out = out.option("parquet.block.size", row_group_bytes)
    if max_rows:
        out = out.option("maxRecordsPerFile", max_rows)
    if dictionary is not None:
        out = out.option("parquet.enable.dictionary", dictionary)
    for column, ndv in (bloom or {}).items():
        out = out.option(f"parquet.bloom.filter.enabled#{column}", True).option(f"parquet.bloom.filter.expected.ndv#{column}", ndv)
    return out


#: The encodings that a column may be given: fixed values.
ENCODINGS = ("PLAIN", "RLE", "BYTE_STREAM_SPLIT", "DELTA_BINARY_PACKED", "DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY")
WRITE_STATS = "file string, rows long, row_groups int, bytes long, plain_bytes long"


def fitting_encodings(df: DataFrame) -> dict[str, str]:
    """An encoding for each column that is not better off with a dictionary: deltas for whole numbers and times, split bytes for floating point, RLE for booleans."""
    fit = {"int": "DELTA_BINARY_PACKED", "bigint": "DELTA_BINARY_PACKED", "timestamp": "DELTA_BINARY_PACKED", "timestamp_ntz": "DELTA_BINARY_PACKED", "float": "BYTE_STREAM_SPLIT", "double": "BYTE_STREAM_SPLIT", "boolean": "RLE"}
    return {n: fit[k] for n, k in df.dtypes if k in fit}


def write_encoded(df: DataFrame, path: str, encodings: dict[str, str], codec: str = "zstd", row_group_rows: int = 128 * 1024, page_index: bool = True) -> DataFrame:
    """Writes a file a task with an encoding chosen for each column (the others get a dictionary), and returns its statistics.

    One row a file: rows, row groups, bytes, and bytes before compression. A file appears under its name when it is
    whole; a task that runs again writes the same rows under the same name. Empty tasks write nothing. The write
    happens when the statistics are computed, so they are computed here, once: a row a task.
    """
    import pyarrow as pa

    if unknown := set(encodings.values()) - set(ENCODINGS):
        raise ValueError(f"no such encodings: {sorted(unknown)}")
    store, folder = store_of(path)
    store.create_dir(folder, recursive=True)
    dictionary = [c for c in df.columns if c not in encodings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        store, folder = store_of(path)
        context, writer, held, n = TaskContext.get(), None, [], 0
        name = f"part-{context.partitionId():05d}.parquet"
        made = f"{folder}/.{name}-{context.taskAttemptId()}"

        def put(rows: list) -> None:
            t = pa.Table.from_batches(rows)
            writer.write_table(t, row_group_size=t.num_rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                file = store.open_output_stream(made)
                writer = pq.ParquetWriter(file, batch.schema, compression=codec, use_dictionary=dictionary, column_encoding=encodings, write_page_index=page_index, version="2.6")
            held.append(batch)
            n += batch.num_rows
            if n >= row_group_rows:
                put(held)
                held, n = [], 0
        if writer is not None:
            if held:
                put(held)
            writer.close()
            file.close()
            with store.open_input_file(made) as f:
                meta, size = pq.ParquetFile(f).metadata, f.size()
            store.move(made, f"{folder}/{name}")
            plain = sum(meta.row_group(g).total_byte_size for g in range(meta.num_row_groups))
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [meta.num_rows], "row_groups": [meta.num_row_groups], "bytes": [size], "plain_bytes": [plain]}, schema=pa.schema([("file", pa.string()), ("rows", pa.int64()), ("row_groups", pa.int32()), ("bytes", pa.int64()), ("plain_bytes", pa.int64())]))

    stats = df.mapInArrow(run, WRITE_STATS).collect()
    return df.sparkSession.createDataFrame(stats, WRITE_STATS)
