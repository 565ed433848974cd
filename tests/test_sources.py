from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, hashing, keys, text, validators, vectors
from tidemark.sources import csvs, footers, interop, logs, wal
from tidemark.streaming import monitors, sink


def test_wal_round_trip_and_damage(spark, tmp_path):
    w = wal.Writer(str(tmp_path), roll_records=3)
    for i in range(7):
        w.append(b"%d|x" % i, ts=100 + i)
    w.close()
    assert len(w.paths) == 3
    assert [(r["seq"], r["timestamp_ns"], bytes(r["payload"])) for r in wal.replay(spark, str(tmp_path)).collect()] == [(i, 100 + i, b"%d|x" % i) for i in range(7)]
    spark.dataSource.register(wal.WalSource)
    assert spark.read.format("wal").load(str(tmp_path)).count() == 7
    assert w.removable(3) == w.paths[:1]
    data = bytearray(open(w.paths[1], "rb").read())
    data[-1] ^= 1
    open(w.paths[1], "wb").write(data)
    assert wal.read(spark, str(tmp_path), "best_effort").count() == 6
    with pytest.raises(Exception, match="CRC mismatch"):
        wal.read(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="empty"):
        wal.record(0, 0, b"")
    assert list(wal.parse(b"")) == [] and list(wal.parse(bytes(data[:30]))) == []


def test_wal_ticks(spark, tmp_path):
    w = wal.Writer(str(tmp_path))
    w.append(b"1|BTC|X|1.0|2.0|3.0|4.0|5.0|6.0", ts=1)
    w.append(b"broken|line", ts=2)
    w.append(b"x|BTC|X|1.0|2.0|3.0|4.0|5.0|6.0", ts=3)
    w.close()
    assert [r["symbol"] for r in wal.ticks(wal.read(spark, str(tmp_path))).collect()] == ["BTC"]


def test_csv_inference(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i,d,b,s,e,f\n1,1.5,true,x,,1\n\n2, 2 ,false,"a,""b""",,0\n,3,TRUE,z\n')
    df = csvs.read_inferred(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "e": "bigint", "f": "bigint"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, "x", 0, 1), (2, 2.0, False, 'a,"b"', 0, 0), (0, 3.0, True, "z", 0, 0)]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("12abc",), ("-3.9",), ("x",), ("1e3",), ("",)], "s string")
    assert [r[0] for r in df.select(text.lenient_long(F.col("s"))).collect()] == [12, -3, 0, 1, 0]


def test_text_forms(spark):
    df = spark.createDataFrame([(0,), (1_700_000_000_123_456_789,)], "n long")
    assert [r[0] for r in df.select(text.iso8601(F.col("n"), 6)).collect()] == ["1970-01-01T00:00:00.000000000Z", "2023-11-14T22:13:20.123456Z"]
    s = spark.createDataFrame([("plain",), ("=a,b",), ('q"x',), ("=x",)], "s string")
    assert [r[0] for r in s.select(text.csv_field(F.col("s"))).collect()] == ["plain", '"\'=a,b"', '"q""x"', "=x"]
    values = [0.0, 1.0, 0.1, 123456789.123, 1e-5, 1.5e20, 12345678901.0, -2.5, 100.0, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(text.significant(F.col("v"))).collect()]
    assert got == ["null" if v != v else f"{v:.10g}" for v in values]


def test_order_keys(spark):
    values = [-1e300, -2.0, -0.5, 0.0, 0.5, 2.0, 1e300]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(keys.normalize_double(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)
    z = spark.createDataFrame([(3, 5)], "x long, y long").select(keys.morton_2d(F.col("x"), F.col("y")), F.hex(keys.morton_nd(F.col("x"), F.col("y"), F.col("x")))).first()
    assert z[0] == 0b100111
    bits = "".join(f"{v:032b}"[i] for i in range(32) for v in (3, 5, 3))
    assert int(z[1], 16) == int(bits, 2)


def test_bytes_and_digests(spark):
    values = [0, 1, 255, 2**40 + 200 * 256 + 195, -1, -(2**63), 0xC3A9C3A9]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(hashing.le64(F.col("v"))).collect()
    assert [bytes(r[0]) for r in got] == [struct.pack("<q", v) for v in values]
    import hashlib
    import hmac

    r = spark.createDataFrame([("abc",)], "s string").select(hashing.hmac_sha256(b"key", F.col("s")), hashing.crc32(F.lit("123456789")), hashing.xxhash64_seed0(F.col("s").cast("binary"))).first()
    assert r[0] == hmac.new(b"key", b"abc", hashlib.sha256).hexdigest() and r[1] == 0xCBF43926 and r[2] == struct.unpack("<q", struct.pack("<Q", 0x44BC2CF5AD770999))[0]
    assert len(hashing.hkdf(b"s", b"", b"i", 50)) == 50


def test_validators(spark):
    df = spark.createDataFrame([("US0378331005", "5493001KJTIIGC8Y1R12", "XNAS"), ("US0378331006", "5493001KJTIIGC8Y1R13", "xnas"), (None, None, None)], "isin string, lei string, mic string")
    got = df.select(validators.validate_isin(F.col("isin")), validators.validate_lei(F.col("lei")), validators.validate_mic(F.col("mic"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, False, False)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = df.select(vectors.l2_normalize(F.col("a")), vectors.l2_normalize(F.col("z")), vectors.dot_product(F.col("a"), F.col("a")), vectors.from_half(vectors.to_half(F.col("a")))).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and r[2] == 25.0 and r[3] == [3.0, 4.0]
    q = spark.createDataFrame([([2.5, 3.5, -200.0, 7.0, -1.0],)], "a array<double>").select(vectors.quantize_int8(F.col("a"), F.lit(1.0)), vectors.dequantize_int4(vectors.quantize_int4(F.col("a"), F.lit(1.0)), F.lit(5), F.lit(1.0))).first()
    assert q[0] == [2, 4, -127, 7, -1] and q[1] == [2.0, 4.0, -7.0, 7.0, -1.0]


def test_column_batches(spark):
    df = spark.createDataFrame([(float(i), i * 2.0) for i in range(10)], "a double, b double")
    back = codecs.from_column_batches(codecs.column_batches(df, ["a", "b"]), ["a", "b"])
    assert sorted(map(tuple, back.collect())) == [(float(i), i * 2.0) for i in range(10)]
    with pytest.raises(ValueError):
        codecs.pack_columns(["a", "b"], [np.zeros(2), np.zeros(3)])


def test_footers_and_pushdown(spark, tmp_path):
    df = spark.range(10_000).withColumn("s", F.concat(F.lit("k"), F.col("id").cast("string")))
    df.coalesce(1).write.option("parquet.block.size", 16 * 1024).parquet(str(tmp_path / "t"))
    stats = footers.file_stats(spark, str(tmp_path / "t")).first()
    assert stats["num_rows"] == 10_000 and stats["row_groups"] >= 1
    assert {r["column_name"]: r["num_values"] for r in footers.column_rollup(spark, str(tmp_path / "t")).collect()} == {"id": 10_000, "s": 10_000}
    plan = spark.read.parquet(str(tmp_path / "t")).filter("id = 7").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_feature_files_and_logs(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.createDataFrame([("a", 1, 1, 2.0)], "entity_id string, timestamp_ns long, version int, x double")
    logs.write_features(df, path, ["x"])
    with pytest.raises(logs.SchemaMismatch):
        logs.write_features(df, path, ["x", "y"])
    rows = spark.createDataFrame([(5, 9, "m", "c"), (0, 1, "m", "c")], "timestamp_ns long, decision_type int, model_version string, chain string").withColumn("risk_result", F.lit(1))
    logs.write_log(rows, str(tmp_path / "log"), "chain", ["decision_type"])
    got = logs.read_decisions(spark, str(tmp_path / "log")).orderBy("chain_seq").collect()
    assert [r["decision_type"] for r in got] == [1, 0] and got[0]["timestamp_ns"] > 0
    with pytest.raises(ValueError, match="validator"):
        logs.write_log(rows, str(tmp_path / "log"), "chain", ["decision_type"], valid=F.col("decision_type") < 5)


def test_interop(spark):
    m = np.arange(6.0).reshape(3, 2)
    df = interop.from_numpy(spark, m)
    assert np.array_equal(interop.to_numpy(df.orderBy("f0")), m)
    assert [r["score"] for r in interop.score_batches(df, ["f0", "f1"], lambda x: x.sum(1)).orderBy("f0").collect()] == [1.0, 5.0, 9.0]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(i, 1 + i % 2, b"p%d" % i) for i in range(20)], "timestamp_ns long, type_id int, payload binary").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("timestamp_ns long, type_id int, payload binary").parquet(source)
    q = sink.compact(stream, str(tmp_path / "out"), str(tmp_path / "ck"), None)
    q.awaitTermination(60)
    got = logs.hybrid_read(spark, str(tmp_path / "out"), start_ns=3, end_ns=12, type_id=2, max_rows=3).collect()
    assert [(r["timestamp_ns"], bytes(r["payload"])) for r in got] == [(3, b"p3"), (5, b"p5"), (7, b"p7")]
    live = spark.createDataFrame([(99, 2, "cDk5")], "timestamp_ns long, type_id int, payload string")
    assert logs.hybrid_read(spark, str(tmp_path / "out"), live).count() == 21


def test_monitors(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", t) for t in (1, 2, 3, 20)] + [("b", 5)], "k string, t long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k string, t long").parquet(source)
    q = monitors.rate_monitor(stream, "k", "t", 5, alert_at=3).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["key"], r["ts"], r["event_count"], r["alert"]) for r in spark.table("rates").collect()) == [("a", 1, 1, False), ("a", 2, 2, False), ("a", 3, 3, True), ("a", 20, 1, False), ("b", 5, 1, False)]
