"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue, storage  # noqa: F401 - storage registers its queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    place = [theirs.index(c) for c in columns]
    assert sorted(str([norm(r[c]) for c in columns]) for r in rows) == sorted(str([norm(r[i]) for i in place]) for r in cursor.fetchall())
