"""Write-ahead-log segments: a batch reader, a data source, and a writer.

A segment is a file header of 16 bytes and records: magic, sequence number, time in nanoseconds, payload size,
payload, CRC-32 over all before it; numbers little-endian. Reading stops at the first record that is cut off, has a
wrong magic, is too large, or fails its CRC: ``best_effort`` keeps what came before, ``strict`` raises.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import store_of

#: Fixed values of the format.
RECORD_MAGIC = 0x57414C31
HEADER_BYTES = 16
MAX_RECORD = 64 * 1024 * 1024
RECORD = struct.Struct("<IqqI")
FILE_MAGIC = b"TIDEMARKWAL1".ljust(HEADER_BYTES, b"\0")
ROLL_BYTES, ROLL_RECORDS = 64 * 1024 * 1024, 1_000_000
SCHEMA = "seq long, timestamp_ns long, payload binary"


class CorruptLog(ValueError):
    """A segment holds a damaged record and reading is strict."""


def record(seq: int, ts: int, payload: bytes) -> bytes:
    if not payload:
        raise ValueError("empty record")
    if len(payload) > MAX_RECORD:
        raise ValueError("record exceeds the greatest size")
    body = RECORD.pack(RECORD_MAGIC, seq, ts, len(payload)) + payload
    return body + struct.pack("<I", zlib.crc32(body))


def parse(data: bytes, strict: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(seq, timestamp_ns, payload) of each sound record."""
    at = HEADER_BYTES
    while at < len(data):
        fault = None
        if at + RECORD.size > len(data):
            fault = "truncated header"
        else:
            magic, seq, ts, size = RECORD.unpack_from(data, at)
            end = at + RECORD.size + size
            if magic != RECORD_MAGIC:
                fault = "bad record magic"
            elif size > MAX_RECORD:
                fault = "oversize record"
            elif end + 4 > len(data):
                fault = "truncated record"
            elif zlib.crc32(data[at:end]) != struct.unpack_from("<I", data, end)[0]:
                fault = "CRC mismatch"
        if fault:
            if strict:
                raise CorruptLog(f"{fault} at byte {at}")
            return
        yield seq, ts, data[at + RECORD.size : end]
        at = end + 4


def read(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Records of all segments under ``path``, one task a segment or several; order by seq for a replay."""
    strict = mode == "strict"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                yield pd.DataFrame(list(parse(bytes(data), strict)), columns=["seq", "timestamp_ns", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def replay(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    return read(spark, path, mode).orderBy("seq")


class Writer:
    """Appends records to segments of a local folder; a segment is rolled by size or number of records."""

    def __init__(self, folder: str, next_seq: int = 0, roll_bytes: int = ROLL_BYTES, roll_records: int = ROLL_RECORDS):
        self.folder, self.next_seq, self.roll_bytes, self.roll_records = folder, next_seq, roll_bytes, roll_records
        self.file, self.paths = None, []

    def append(self, payload: bytes, ts: int | None = None) -> int:
        data = record(self.next_seq, time.time_ns() if ts is None else ts, payload)
        if self.file is None or self.size + len(data) > self.roll_bytes or self.count >= self.roll_records:
            self.roll()
        self.file.write(data)
        self.size, self.count, self.next_seq = self.size + len(data), self.count + 1, self.next_seq + 1
        return self.next_seq - 1

    def roll(self) -> None:
        self.close()
        self.paths.append(f"{self.folder}/wal-{len(self.paths):08d}.wal")
        self.file = open(self.paths[-1], "wb")  # noqa: SIM115
        self.file.write(FILE_MAGIC)
        self.size, self.count = HEADER_BYTES, 0

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def removable(self, checkpoint_seq: int) -> list[str]:
        """Closed segments whose records all come before the checkpoint; the active one never is."""
        out = []
        for path in self.paths[:-1] if self.file is not None else self.paths:
            with open(path, "rb") as f:
                if all(seq < checkpoint_seq for seq, _, _ in parse(f.read())):
                    out.append(path)
        return out


def write_segments(df: DataFrame, path: str, order: list[str], payload: str = "payload", ts: str = "timestamp_ns", roll_bytes: int = ROLL_BYTES, roll_records: int = ROLL_RECORDS) -> DataFrame:
    """Rows as records, numbered in ``order``, in segments of the shared folder ``path``; a row a segment: file, first_seq, last_seq, bytes.

    Rows are sorted by range and numbered without meeting in one task; each task writes its own segments, rolled by
    size and number, under names that sort in sequence. A task that runs again writes the same segments.
    """
    from ..operators.aggregates import with_rank

    store, folder = store_of(path)
    store.create_dir(folder, recursive=True)
    numbered = with_rank(df.select(F.struct(*order).alias("k"), F.col(ts).alias("ts"), F.col(payload).cast("binary").alias("payload")), "k")
    dealt = numbered.select((F.col("rank") - 1).alias("seq"), "ts", "payload").repartitionByRange("seq").sortWithinPartitions("seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        store, folder = store_of(path)
        attempt, file, rows = TaskContext.get().taskAttemptId(), None, []

        def end():
            file.close()
            name = f"wal-{first:020d}.wal"
            store.move(made, f"{folder}/{name}")
            rows.append((name, first, last, size))

        for frame in frames:
            for seq, when, data in zip(frame["seq"], frame["ts"], frame["payload"], strict=True):
                one = record(int(seq), int(when), bytes(data))
                if file is not None and (size + len(one) > roll_bytes or last - first + 1 >= roll_records):
                    end()
                    file = None
                if file is None:
                    first, size = int(seq), HEADER_BYTES
                    made = f"{folder}/.wal-{first:020d}-{attempt}"
                    file = store.open_output_stream(made)
                    file.write(FILE_MAGIC)
                file.write(one)
                last, size = int(seq), size + len(one)
        if file is not None:
            end()
        yield pd.DataFrame(rows, columns=["file", "first_seq", "last_seq", "bytes"])

    made = dealt.mapInPandas(run, "file string, first_seq long, last_seq long, bytes long").collect()  # a row a segment
    return df.sparkSession.createDataFrame(made, "file string, first_seq long, last_seq long, bytes long")


def removable_segments(segments: DataFrame, checkpoint_seq: int) -> DataFrame:
    """Segments whose records all come before the checkpoint."""
    return segments.filter(F.col("last_seq") < checkpoint_seq)


def prune(segments: DataFrame, path: str, checkpoint_seq: int) -> int:
    """Deletes those segments, and tells how many."""
    store, folder = store_of(path)
    names = [r["file"] for r in removable_segments(segments, checkpoint_seq).select("file").toLocalIterator()]
    for name in names:
        store.delete_file(f"{folder}/{name}")
    return len(names)


class WalSource(DataSource):
    """``spark.read.format("wal").option("mode", ...).load(path)`` for segments on a path that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WalReader(self.options)


class _WalReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.strict = options["path"], options.get("mode", "strict") == "strict"

    def partitions(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = store.get_file_info(fs.FileSelector(path))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file]

    def read(self, partition):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_stream(partition.value) as f:
            yield from parse(f.read(), self.strict)


TICK = "timestamp_ms long, symbol string, exchange string, bid_price double, ask_price double, bid_qty double, ask_qty double, spread_bps double, mid_price double"


def ticks(wal: DataFrame) -> DataFrame:
    """Ticks of payloads with nine fields between bars; malformed ones are left out."""
    names = [f.split() for f in TICK.split(", ")]
    parts = F.split(F.decode("payload", "UTF-8"), r"\|")
    typed = wal.select(parts.alias("p")).filter(F.size("p") == len(names)).select(*[F.get("p", F.lit(i)).try_cast(kind).alias(n) for i, (n, kind) in enumerate(names)])
    return typed.dropna()
