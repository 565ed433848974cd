"""Helpers shared by the training-data operators: shared folders, caches, batches."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts are long, so batches are short: a worker holds one batch at a time.
BATCH_ROWS = 512
#: Bytes of one Arrow batch: a few very long texts fill one by themselves.
BATCH_BYTES = 32 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold Arrow batches to ``rows`` rows and BATCH_BYTES, so that a worker's memory follows the longest text and not the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` under spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset (tests, a local master) a temporary folder is set as it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of a column as text, modulo n; null gives null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


_caches: list[weakref.ref] = []
_claimed: list[str] = []


def claim(module: str) -> None:
    """Empties the caches that other operators filled: workers live on from stage to stage, their caches need not."""
    if _claimed != [module]:
        _claimed[:] = [module]
        for ref in list(_caches):
            cache = ref()
            if cache is None:
                _caches.remove(ref)
            elif cache.make.__module__ != module:
                cache.clear()
                cache.old, cache.held = {}, 0


#: Bytes of one generation of a cache, as its entries are estimated.
CACHE_BYTES = 40 << 20


def _bytes_of(x) -> int:
    return sys.getsizeof(x) + (sum(map(sys.getsizeof, x)) if isinstance(x, tuple) else 0)


class TwoGenerations(dict):
    """A cache of at most two generations of ``most_bytes``: when the young one is full it becomes the old one.

    Entries in use move back to the young generation, so that frequent keys stay. Entries count by the bytes of key and
    value, so long keys (encoded data, minified code) fill it no further than short ones.
    """

    def __init__(self, make: Callable, most_bytes: int = CACHE_BYTES):
        super().__init__()
        self.most_bytes, self.make, self.old, self.held = most_bytes, make, {}, 0
        _caches.append(weakref.ref(self))

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if self.held > self.most_bytes:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += 80 + _bytes_of(key) + _bytes_of(got)
        self[key] = got
        return got


def map_batches(df: DataFrame, keep: list[str], work: Callable[[pa.RecordBatch], dict], schema, uses: list[str]) -> DataFrame:
    """Columns ``keep`` of each row, and the columns that ``work`` makes of the row's batch of columns ``uses``."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [df.schema[c] for c in keep] + list(schema.fields)
    out = to_arrow_schema(T.StructType(fields))

    owner = work.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        for batch in batches:
            made = work(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).cast(out.field(c).type) for c in keep] + [pa.array(made[f.name], out.field(f.name).type) for f in schema.fields],
                schema=out,
            )

    return df.select(*dict.fromkeys([*keep, *uses])).mapInArrow(run, T.StructType(fields))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def open_store(uri: str):
    """(pyarrow file system, path) for a URI of the shared folder: file, hdfs, s3, gs."""
    from pyarrow import fs

    if (path := local_path(uri)) is not None:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def make_dirs(uri: str) -> None:
    if (path := local_path(uri)) is not None:
        os.makedirs(path, exist_ok=True)
    else:
        store, path = open_store(uri)
        store.create_dir(path, recursive=True)
