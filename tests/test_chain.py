from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import ZERO_HASH
from tidemark.operators import chain
from tidemark.sources.tables import scratch
from tidemark.streaming import monitors, sink


def entries(spark, n=30):
    df = spark.createDataFrame([("c1" if i % 3 else "c2", 200 + i * 12345678901, f"p{i}".encode()) for i in range(n)], "chain string, ts long, data binary")
    return chain.create(df, "chain", ["ts"], "ts", "data").cache()


def test_sound_chain_verifies(spark):
    assert {(r["entries"], r["valid"]) for r in chain.verify(entries(spark), ["chain"], "ts", "data").collect()} == {(20, True), (10, True)}


def test_tampering_is_found_at_the_first_entry(spark):
    rows = entries(spark)
    cases = {
        "HASH": F.when(F.col("chain_seq") == 4, F.lit(b"x")).otherwise(F.col("data")),
    }
    bad = rows.withColumn("data", cases["HASH"])
    got = {r["chain"]: (r["valid"], r["first_bad"], r["bad_reason"]) for r in chain.verify(bad, ["chain"], "ts", "data").collect()}
    assert got == {"c1": (False, 4, "HASH"), "c2": (False, 4, "HASH")}
    gone = rows.filter("chain_seq <> 3")
    assert {r["bad_reason"] for r in chain.verify(gone, ["chain"], "ts", "data").collect()} == {"SEQUENCE"}
    relinked = rows.withColumn("prev_hash", F.when(F.col("chain_seq") == 2, F.lit("f" * 64)).otherwise(F.col("prev_hash")))
    assert {(r["first_bad"], r["bad_reason"]) for r in chain.verify(relinked, ["chain"], "ts", "data").collect()} == {(2, "LINK")}


def test_rotated_file_verifies_from_where_the_first_ended(spark):
    rows = entries(spark).filter("chain = 'c1'")
    first = rows.filter("chain_seq < 7")
    last = first.orderBy(F.desc("chain_seq")).first()
    second = rows.filter("chain_seq >= 7")
    assert chain.verify(second, ["chain"], "ts", "data").first()["valid"] is False
    assert chain.verify(second, ["chain"], "ts", "data", first_seq=7, prev_hash=last["chain_hash"]).first()["valid"] is True
    meta = chain.segment_metadata(rows.withColumn("file", F.when(F.col("chain_seq") < 7, "f1").otherwise("f2")), "file")
    assert [r["continuous"] for r in chain.continuity(meta).orderBy("first_seq").collect()] == [True, True]
    assert [r["continuous"] for r in chain.continuity(meta.withColumn("first_prev_hash", F.lit(ZERO_HASH))).orderBy("first_seq").collect()] == [True, False]


def test_lineage_numbers_rows(spark):
    df = spark.createDataFrame([(1, i, bytes([i])) for i in range(5)], "k int, t long, data binary")
    got = chain.lineage(df, "k", ["t"], "data", "f").orderBy("t").collect()
    assert [r["row_id"] for r in got] == list(range(5)) and got[0]["row_prev_hash"] == ZERO_HASH and len({r["row_prev_hash"] for r in got}) == 5


def test_monitor_puts_a_micro_batch_in_order_and_goes_on_from_the_one_before(spark):
    rows = entries(spark, 300)
    path = scratch(spark, "monitored")

    def watched(part, *bad):
        """Entries over several files, the later ones of a chain in the earlier files."""
        bad_hash = F.when(F.col("chain_seq").isin(*bad), F.lit("0" * 64)).otherwise(F.col("data_hash"))
        part.drop("data").withColumn("data_hash", bad_hash).orderBy(F.desc("chain_seq")).repartition(5).write.mode("append").parquet(f"{path}/in")
        q = monitors.chain_monitor(sink.held_back(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema), "chain", "ts", path)
        q.awaitTermination()
        got = spark.read.parquet(f"{path}/out")
        return got.count(), {(r["chain"], r["chain_seq"], r["reason"]) for r in got.filter("reason is not null").collect()}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert watched(rows.filter("chain_seq < 40"), 5) == (80, {("c1", 5, "HASH"), ("c2", 5, "HASH")})
        first = {("c1", 5, "HASH"), ("c2", 5, "HASH")}
        assert watched(rows.filter("chain_seq between 40 and 79 and chain = 'c1'")) == (120, first)
        # c2 was not in the batch before; entry 81 is missing, and 90 carries another link
        more = rows.filter("(chain = 'c2' and chain_seq >= 40) or (chain = 'c1' and chain_seq >= 80)").filter("chain = 'c2' or chain_seq <> 81")
        more = more.withColumn("prev_hash", F.when(F.col("chain_seq") == 90, F.lit("f" * 64)).otherwise(F.col("prev_hash")))
        n, bad = watched(more)
        assert (n, bad - first) == (299, {("c1", 82, "SEQUENCE"), ("c1", 90, "LINK"), ("c2", 90, "LINK")})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
