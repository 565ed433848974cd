"""Hash chains: creation, verification, continuity over files, row lineage.

An entry's hash is SHA-256 of its sequence number, time, the previous entry's hash and its data's hash. Creation is
sequential inside a chain and parallel over chains; rows stream through a task in order, so a chain is never held in
memory. Verification needs only each row and the row before it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import ZERO_HASH, entry_hash, sha256


def _folded(df: DataFrame, by: str, order: list[str], out: T.StructType, begin, step) -> DataFrame:
    """Rows of each ``by`` in order through ``step(state, row) -> (state, new columns)``, a task at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = df.schema.fields + out.fields
    schema = to_arrow_schema(T.StructType(fields))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = None, object()
        for batch in batches:
            made: list[tuple] = []
            for row in batch.to_pylist():
                if row[by] != at:
                    at, state = row[by], begin()
                state, new = step(state, row)
                made.append(new)
            columns = [batch.column(n).cast(schema.field(n).type) for n in names]
            new = list(zip(*made, strict=True)) if made else [[] for _ in out.fields]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, schema.field(f.name).type) for c, f in zip(new, out.fields, strict=True)]], schema=schema)

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, T.StructType(fields))


def create(df: DataFrame, by: str, order: list[str], ts: str, data: str, first_seq: int = 0, prev_hash: str = ZERO_HASH) -> DataFrame:
    """Adds chain_seq, prev_hash, data_hash, chain_hash; a chain may continue another from a sequence number and hash."""

    def step(state, row):
        seq, prev = state
        data_hash = hashlib.sha256(row[data]).digest()
        own = hashlib.sha256(struct.pack("<Qq", seq, row[ts]) + prev + data_hash).digest()
        return (seq + 1, own), (seq, prev.hex(), data_hash.hex(), own.hex())

    out = T.StructType([T.StructField("chain_seq", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("prev_hash", "data_hash", "chain_hash")]])
    return _folded(df, by, order, out, lambda: (first_seq, bytes.fromhex(prev_hash)), step)


def checked(df: DataFrame, by: list[str], ts: str, data: str | None = None, first_seq: int = 0, prev_hash: str = ZERO_HASH) -> DataFrame:
    """Adds reason: null for a sound entry, else the first of SEQUENCE, LINK, HASH, TIME that fails.

    The first entry of a chain must carry ``first_seq`` and ``prev_hash``, which rotated files take from the file before.
    """
    seen = Window.partitionBy(*by).orderBy("chain_seq")
    place = F.row_number().over(seen) - 1 + first_seq
    before = F.coalesce(F.lag("chain_hash").over(seen), F.lit(prev_hash))
    data_hash = sha256(F.col(data)) if data else F.col("data_hash")
    reason = (
        F.when(F.col("chain_seq") != place, "SEQUENCE")
        .when(F.col("prev_hash") != before, "LINK")
        .when(F.col("chain_hash") != entry_hash(F.col("chain_seq"), F.col(ts), F.col("prev_hash"), data_hash), "HASH")
        .when(F.col(ts) < F.lag(ts).over(seen), "TIME")
    )
    return df.withColumn("reason", reason)


def verify(df: DataFrame, by: list[str], ts: str, data: str | None = None, first_seq: int = 0, prev_hash: str = ZERO_HASH) -> DataFrame:
    """Per chain: entries, valid, and the first bad entry with its reason."""
    rows = checked(df, by, ts, data, first_seq, prev_hash)
    bad = F.col("reason").isNotNull()
    return rows.groupBy(*by).agg(F.count("*").alias("entries"), (F.count_if(bad) == 0).alias("valid"), F.min(F.when(bad, F.col("chain_seq"))).alias("first_bad"), F.min_by("reason", F.when(bad, F.col("chain_seq"))).alias("bad_reason"))


def segment_metadata(df: DataFrame, file: str, by: list[str] | None = None) -> DataFrame:
    """First and last sequence number and hashes of each file of a chain."""
    return df.groupBy(*(by or []), file).agg(
        F.count("*").alias("entries"), F.min("chain_seq").alias("first_seq"), F.max("chain_seq").alias("last_seq"), F.min_by("prev_hash", "chain_seq").alias("first_prev_hash"), F.max_by("chain_hash", "chain_seq").alias("last_hash")
    )


def continuity(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds continuous: whether a file goes on where the one before it ended; the first file does."""
    seen = Window.partitionBy(*(by or [])).orderBy("first_seq")
    before = F.lag("last_hash").over(seen)
    return segments.withColumn("continuous", before.isNull() | (before == F.col("first_prev_hash")))


def lineage(df: DataFrame, by: str, order: list[str], data: str, origin: str, version: int = 1) -> DataFrame:
    """Adds row_id, row_version, row_origin_file and row_prev_hash, a running SHA-256 over previous hash text and row bytes."""

    def step(state, row):
        number, prev = state
        own = hashlib.sha256(prev.encode() + row[data]).hexdigest()
        return (number + 1, own), (number, version, origin, prev)

    out = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("row_version", T.IntegerType()), T.StructField("row_origin_file", T.StringType()), T.StructField("row_prev_hash", T.StringType())])
    return _folded(df, by, order, out, lambda: (0, ZERO_HASH), step)
