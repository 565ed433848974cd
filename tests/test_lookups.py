from __future__ import annotations

import bisect
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, asof, lookups, scan, windows
from tidemark.plans import catalogue, storage  # noqa: F401 - storage registers its queries
from tidemark.sources.tables import scratch


@pytest.fixture(scope="module")
def rows(spark):
    # ties in time, corrections by version, interleaved entities
    data = [("a", 10, 1, 1.0), ("a", 10, 2, 2.0), ("a", 20, 1, 3.0), ("b", 5, 1, 4.0), ("b", 30, 3, 5.0), ("a", 15, 9, 6.0), (None, 1, 1, 7.0)]
    return spark.createDataFrame(data, "entity_id string, timestamp_ns long, version int, f double")


def test_as_of_join_ties_versions_and_misses(spark, rows):
    spine = spark.createDataFrame([(1, "a", 9), (2, "a", 10), (3, "a", 19), (4, "a", 99), (5, "b", 4), (6, "c", 50), (7, "a", 10)], "id int, entity_id string, timestamp_ns long")
    got = {r["id"]: r["f"] for r in asof.as_of_join(spine, rows, "entity_id", "timestamp_ns", ["f"], version="version").collect()}
    assert got == {1: None, 2: 2.0, 3: 6.0, 4: 3.0, 5: None, 6: None, 7: 2.0}
    inner = asof.as_of_join(spine, rows, "entity_id", "timestamp_ns", ["f"], version="version", keep_unmatched=False)
    assert {r["id"] for r in inner.collect()} == {2, 3, 4, 7}


def test_as_of_join_of_empty_tables(spark, rows):
    spine = spark.createDataFrame([], "id int, entity_id string, timestamp_ns long")
    assert asof.as_of_join(spine, rows, "entity_id", "timestamp_ns", ["f"]).count() == 0
    one = spark.createDataFrame([(1, "a", 9)], "id int, entity_id string, timestamp_ns long")
    assert asof.as_of_join(one, rows.limit(0), "entity_id", "timestamp_ns", ["f"]).collect()[0]["f"] is None


def test_as_of_join_shuffles_once(spark, rows):
    spine = spark.createDataFrame([(1, "a", 9)], "id int, entity_id string, timestamp_ns long")
    plan = asof.as_of_join(spine, rows, "entity_id", "timestamp_ns", ["f"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_batch_keeps_order_repeats_and_drops_misses(spark, rows):
    asked = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2), ("b", 3)], "entity_id string, position int")
    got = asof.as_of_batch(rows, asked, "entity_id", "timestamp_ns", 12, version="version").orderBy("position").collect()
    assert [(r["position"], r["f"]) for r in got] == [(0, 4.0), (1, 2.0), (3, 4.0)]


def test_latest_and_history(rows):
    assert {r["entity_id"]: r["f"] for r in asof.latest(rows, "entity_id", "timestamp_ns", "version").collect()} == {"a": 3.0, "b": 5.0, None: 7.0}
    assert [r["f"] for r in asof.history(rows, "entity_id", "a", "timestamp_ns", 10, 15, ["version"]).collect()] == [1.0, 2.0, 6.0]


def test_projection_errors(rows):
    with pytest.raises(scan.SchemaMismatch):
        scan.project(rows, ["nope"])
    with pytest.raises(scan.SchemaMismatch):
        scan.project_features(rows, ["version"])
    assert scan.project(rows, ["f", "entity_id"]).columns == ["f", "entity_id"]
    assert scan.authorised(rows, []).columns == rows.columns


def test_lookup_of_missing_id(rows):
    with pytest.raises(lookups.NotFound):
        lookups.by_id(rows, "entity_id", "zz")


def test_sliding_rate_is_the_loop(spark):
    times = sorted([(i * 7919) % 50 for i in range(200)])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, t long")
    for got in (windows.sliding_rate(df, "t", 6, "id", alert_at=20), windows.sliding_rate_bucketed(df, "t", 6, "id", alert_at=20)):
        for r in got.collect():
            seen = times[: r["id"] + 1]
            want = len(seen) - bisect.bisect_left(seen, r["t"] - 6)
            assert (r["event_count"], r["alert"]) == (want, want >= 20)


def test_sliding_rate_of_keys_by_spans(spark):
    df = spark.createDataFrame([(i, i % 3, (i * 7919) % 90) for i in range(300)], "id int, k int, t long")
    one, other = windows.sliding_rate(df, "t", 9, "id", ["k"]), windows.sliding_rate_bucketed(df, "t", 9, "id", ["k"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.select(*one.columns).collect()))


@pytest.mark.parametrize("spans", [1, 3, 64])
def test_as_of_join_by_spans_is_the_plain_one(spark, spans):
    rnd = random.Random(spans)
    features = spark.createDataFrame([(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.randrange(100), i, float(i)) for i in range(400)], "k string, t long, v int, f double")
    spine = spark.createDataFrame([(i, rnd.choice(["hot", "b", "none", None]), rnd.randrange(-10, 120)) for i in range(200)], "id int, k string, t long")
    for rows in (features, features.limit(0)):
        one = asof.as_of_join(spine, rows, "k", "t", ["f"], version="v")
        other = asof.as_of_join_by_spans(spine, rows, "k", "t", ["f"], version="v", spans=spans)
        assert sorted(map(str, one.collect())) == sorted(map(str, other.select(*one.columns).collect()))


@pytest.mark.parametrize("interpolate", [False, True])
def test_quantiles_are_those_of_the_sorted_values(spark, interpolate):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, float("inf"), rnd.gauss(0, 1), round(rnd.gauss(0, 1)) + 0.0])) for _ in range(3000)] + [("one", 7.0)]
    points = {"lo": 0.0, "p3": 0.3, "mid": 0.5, "p99": 0.99, "hi": 1.0}
    df = spark.createDataFrame(rows, "g string, x double")
    for by in ([], ["g"]):
        got = {r["g"] if by else 0: r for r in aggregates.quantiles(df, "x", points, by, interpolate).collect()}
        groups = {g if by else 0 for g, x in rows if x is not None}
        assert set(got) == groups
        for g in groups:
            v = sorted(x for h, x in rows if x is not None and (not by or h == g))
            for name, p in points.items():
                k = int(p * (len(v) - 1))
                part = p * (len(v) - 1) - k
                want = v[k] if not interpolate or not part else (1 - part) * v[k] + part * v[min(k + 1, len(v) - 1)]
                assert got[g][name] == pytest.approx(want) or interpolate and want == float("inf") and not got[g][name] < want
    assert aggregates.quantiles(df.limit(0), "x", points, ["g"]).count() == 0


def test_ranks_are_one_upward(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    assert [(r["k"], r["rank"]) for r in aggregates.with_rank(df, "k").orderBy("k").collect()] == [(k, i) for i, k in enumerate(sorted(i * 7919 % 5003 for i in range(5000)), 1)]


def test_gaps_and_steps(spark):
    df = spark.createDataFrame([(1,), (5,), (6,), (20,)], "t long")
    assert [(r["gap_start"], r["gap_end"]) for r in windows.gaps(df, "t", 4).collect()] == [(6, 20)]
    steps = spark.createDataFrame([("s1", 10), ("s2", 0), ("s3", 5)], "step_id string, sla_seconds long")
    done = spark.createDataFrame([("s1", 0, 10_000_000_000), ("s2", 0, 99_000_000_000), ("s9", 0, 1), ("s3", 5, 1)], "step_id string, started_at_ns long, completed_at_ns long")
    assert {r["step_id"]: r["status"] for r in lookups.checked_steps(done, steps).collect()} == {"s1": "MET", "s2": "MET", "s9": "UNKNOWN_STEP", "s3": "BAD_TIMES"}
    assert lookups.all_complete(steps, done, strict=False).first()[0] is False
    assert [r["step_id"] for r in lookups.remaining_steps(steps, done.filter("step_id <> 's3'").select(F.col("step_id")), ["step_id"]).collect()] == ["s3"]


def _three_files(spark):
    """Ids 0 .. 29 over three files, none in the order of the ids, and a null id."""
    path = scratch(spark, "places")
    for i in range(3):
        ids = [j for j in range(29, -1, -1) if j % 3 == i] + [None] * (i == 0)
        spark.createDataFrame([(j, f"v{j}", 7) for j in ids], "vec_id long, v string, rank int").coalesce(1).write.mode("append").parquet(path)
    return path


def test_row_index_counts_over_all_files(spark):
    path = _three_files(spark)
    rows = scan.by_row_index(spark, path, ["vec_id"])
    assert rows.columns == ["row_index", "vec_id", "v", "rank"]
    assert sorted(tuple(r) for r in rows.collect()) == [(j, j, f"v{j}", 7) for j in range(30)] + [(30, None, "vNone", 7)]
    by_file = sorted(tuple(r) for r in scan.by_row_index(spark, path, columns=["vec_id"]).collect())
    assert [i for i, _ in by_file] == list(range(31))
    steps = [b - a for (_, a), (_, b) in zip(by_file, by_file[1:], strict=False) if None not in (a, b)]
    assert steps.count(-3) == 27 and len(steps) >= 28  # inside each file the rows stay in their order


def test_vector_queries_over_several_files(spark, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    for i in range(3):
        spark.createDataFrame([(j, [0.18, j / 7], 0) for j in range(i, 30, 3)], "vec_id long, embedding array<float>, label int").coalesce(1).write.mode("append").parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    for name in ("vector_by_index", "vectors_at_places"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        theirs = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(list, got.collect())) == sorted(map(list, theirs))
