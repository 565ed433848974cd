"""Session settings and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that results rely on; sizes stay with the cluster.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a timestamp without time zone, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; under a local master without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store_of(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows whatever the encoding of their columns: files are read in batches by the executors where Spark's own reader does not know one."""
    from pyspark.sql.pandas.types import from_arrow_schema

    import pyarrow.parquet as pq

    store, folder = store_of(path)
    from pyarrow import fs

    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and not f.base_name.startswith((".", "_")))
    with store.open_input_file(names[0]) as handle:
        schema = pq.ParquetFile(handle).schema_arrow
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                s, name = store_of(file)
                with s.open_input_file(name) as handle:
                    yield from pq.ParquetFile(handle).iter_batches()

    return files.mapInArrow(run, from_arrow_schema(schema, prefer_timestamp_ntz=True))


def features(spark: SparkSession, paths: list[str], feature_group: str | None = None, damaged: str = "fail") -> DataFrame:
    """Feature rows of all files. A group is checked against its column.

    ``damaged``: ``fail`` at a missing or damaged file, or ``skip`` it; ``footers.damaged`` lists such files.
    """
    skip = {"fail": False, "skip": True}[damaged]
    df = spark.read.option("ignoreMissingFiles", skip).option("ignoreCorruptFiles", skip).parquet(*paths)
    if feature_group is not None and "feature_group" in df.columns:
        df = df.filter(F.col("feature_group") == feature_group)
    return df
