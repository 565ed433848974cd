"""``python -m tidemark.cli inspect|schema|head|count|validate|convert PATH [...]``"""

from __future__ import annotations

import argparse

from .sources import csvs, footers
from .sources.tables import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("command", choices=["inspect", "schema", "head", "count", "validate", "convert"])
    p.add_argument("path")
    p.add_argument("out", nargs="?", help="convert: the Parquet folder to write")
    p.add_argument("-n", type=int, default=10, help="head: rows")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    spark = session(a.master)
    if a.command == "convert":
        csvs.read_inferred(spark, a.path).write.parquet(a.out)
        return 0
    df = spark.read.parquet(a.path)
    if a.command == "inspect":
        footers.file_stats(spark, a.path).show(1000, truncate=False)
        footers.column_rollup(spark, a.path).show(1000, truncate=False)
    elif a.command == "schema":
        df.printSchema()
    elif a.command == "head":
        df.limit(a.n).show(a.n, truncate=False)
    elif a.command == "count":
        print(df.count())
    else:
        try:
            df.write.format("noop").mode("overwrite").save()  # reads every page of every column
        except Exception as e:
            print(f"invalid: {e}")
            return 1
        print("valid")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
