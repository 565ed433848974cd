from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make themselves, to clash with.
CLASHING = ("score", "node", "text_hash", "spans", "ids", "group", "label", "quality", "m", "n_words", "alone", "kept")


@pytest.fixture
def tables(spark, tmp_path):
    """put(documents=..., labels=..., benchmark=..., pages=...) writes tables to a folder and returns it."""

    def put(**given):
        shapes = {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string"}
        for name, rows in given.items():
            spark.createDataFrame(rows, shapes[name]).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        for name in shapes:
            if name not in given:
                spark.createDataFrame([], shapes[name]).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text) if text is not None else None)


LONG = "alpha beta gamma delta " * 30_000
#: Null and empty texts, null ids and other columns, white space, a very long text, repeated rows, repeated ids.
ODD = [doc(1, None), doc(2, ""), doc(3, " \n\t "), (None, "a text without an id", None, None, None), doc(4, LONG), doc(5, "same row here"), doc(5, "same row here"), doc(6, "first of an id"), doc(6, "second of an id"), doc(7, "日本語 éà ñ 👍🏽 \u0000 x")]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
