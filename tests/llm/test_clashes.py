"""Every query over tables with further columns whose names its operator uses itself."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.queries import QUERIES

from .conftest import CLASHING, ODD

NAMES = (*CLASHING, "hash", "at", "words", "slots", "item_words", "covered", "base", "made", "bin", "d2", "x0", "row", "sums", "y", "x", "word", "held", "teaches", "bucket", "size", "signature", "bands", "copies", "class_id", "d", "h", "w", "n_tokens", "decoded", "lang_pred", "bits", "rejected", "held_out", "predicted", "text_", "count")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_clashing_columns(name, spark, tables, tmp_path):
    rows = [*ODD, (60, "plain prose with words in it, and more of them than a few", "en", "s", 1)]
    plain = tables(documents=rows, labels=[(i, i % 2, 0) for i in range(1, 8)], benchmark=[(1, "plain prose with words in it, and more of them")], pages=[(1, "u", "<article><p>a, b.</p></article>"), (None, None, None)])
    wide = str(tmp_path / "wide")
    for t in ("documents", "labels", "benchmark", "pages"):
        df = table(spark, plain, t)
        df.select("*", *[F.lit("clash").alias(c) for c in NAMES if c not in df.columns]).write.parquet(f"{wide}/{t}.parquet")
    want, got = QUERIES[name](spark, plain), QUERIES[name](spark, wide)
    assert got.columns == want.columns
    # float sums of two runs may differ in the last places
    digest = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert digest(got) == digest(want)
