"""Record and batch byte forms."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import le64


def features_to_json(features: Column) -> Column:
    return F.to_json(features)


def features_from_json(text: Column, kind: str = "array<double>") -> Column:
    return F.from_json(text, kind)


def encode_payload(col: Column) -> Column:
    return F.base64(col.cast("binary"))


def decode_payload(col: Column) -> Column:
    return F.unbase64(col)


def le_text(col: Column) -> Column:
    """Length (4 little-endian bytes) and UTF-8 bytes."""
    raw = F.coalesce(col, F.lit("")).cast("binary")
    return F.concat(F.substring(le64(F.octet_length(raw).cast("long")), 1, 4), raw)


@F.pandas_udf(T.BinaryType())
def le_double(x: pd.Series) -> pd.Series:
    return x.map(lambda v: struct.pack("<d", v if v is not None else 0.0))


def record_bytes(longs: list[Column], doubles: list[Column], texts: list[Column]) -> Column:
    """A record's deterministic bytes: longs, doubles, then texts with their lengths, all little-endian; null longs are 0."""
    return F.concat(*[le64(F.coalesce(c.cast("long"), F.lit(0).cast("long"))) for c in longs], *[le_double(c.cast("double")) for c in doubles], *[le_text(c.cast("string")) for c in texts])


def pack_columns(names: list[str], columns: list[np.ndarray]) -> bytes:
    """Number of columns and rows (uint32 each), names (uint32 length, bytes), then float64 values column by column."""
    rows = len(columns[0]) if columns else 0
    if any(len(c) != rows for c in columns):
        raise ValueError("columns differ in length")
    head = struct.pack("<II", len(names), rows) + b"".join(struct.pack("<I", len(n.encode())) + n.encode() for n in names)
    return head + b"".join(np.ascontiguousarray(c, "<f8").tobytes() for c in columns)


def unpack_columns(data: bytes) -> tuple[list[str], list[np.ndarray]]:
    n, rows = struct.unpack_from("<II", data)
    at, names = 8, []
    for _ in range(n):
        size = struct.unpack_from("<I", data, at)[0]
        names.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    if len(data) != at + 8 * n * rows:
        raise ValueError("column batch has a wrong size")
    return names, [np.frombuffer(data, "<f8", rows, at + 8 * rows * k) for k in range(n)]


def column_batches(df, columns: list[str]):
    """One binary row an Arrow batch: its numeric columns packed."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"rows": [len(f)], "batch": [pack_columns(columns, [f[c].to_numpy("float64") for c in columns])]})

    return df.select(*[F.col(c).cast("double") for c in columns]).mapInPandas(run, "rows long, batch binary")


def from_column_batches(df, columns: list[str], batch: str = "batch"):
    def run(frames):
        for f in frames:
            for data in f[batch]:
                names, values = unpack_columns(bytes(data))
                yield pd.DataFrame(dict(zip(names, values, strict=True)))[columns]

    return df.select(batch).mapInPandas(run, ", ".join(f"`{c}` double" for c in columns))
