"""Arrow and numpy exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Tensor element types of column types: fixed values.
DTYPES = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def dtype_of(kind: str) -> str | None:
    """The tensor element type of a column type; arrays have that of their elements, other types none."""
    kind = kind.removeprefix("array<").removesuffix(">")
    return DTYPES.get(kind)


def column_type(dtype: str) -> str | None:
    return {v: k for k, v in DTYPES.items()}.get(dtype)


def schema_dtypes(df: DataFrame) -> DataFrame:
    """(column_name, column_type, dtype) of a frame."""
    return df.sparkSession.createDataFrame([(n, k, dtype_of(k)) for n, k in df.dtypes], "column_name string, column_type string, dtype string")


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def from_numpy(spark: SparkSession, matrix: np.ndarray, names: list[str] | None = None) -> DataFrame:
    matrix = matrix.reshape(len(matrix), -1)
    names = names or [f"f{i}" for i in range(matrix.shape[1])]
    return spark.createDataFrame(pa.table({n: pa.array(np.ascontiguousarray(matrix[:, i])) for i, n in enumerate(names)}))


def to_numpy(df: DataFrame) -> np.ndarray:
    """A small frame as one matrix on the driver."""
    t = df.toArrow()
    return np.stack([t.column(c).to_numpy() for c in t.column_names], axis=1)


def score_batches(df: DataFrame, columns: list[str], score, out: str = "score") -> DataFrame:
    """Adds what ``score`` (float32 matrix -> vector, such as a model session's run) gives for each batch of rows."""
    from pyspark.sql import types as T

    def run(frames):
        for f in frames:
            f[out] = np.asarray(score(f[columns].to_numpy("float32")), "float64").reshape(-1)
            yield f

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
