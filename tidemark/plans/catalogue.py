"""Registered queries over the driver's tables, each with its SQL for DuckDB.

``@query(sql)`` registers a function under its name; without SQL only its rows can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, hashing, keys, text, validators, vectors
from ..operators import aggregates, asof, chain, governance, layout, lookups, scan, security, windows
from ..sources.tables import load, micros
from . import reports

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as ts_us, microseconds."""
    return load(spark, sf_dir, "events").withColumn("ts_us", micros("ts"))


EVENTS = "e AS (SELECT *, epoch_us(ts) AS ts_us FROM events)"
MID_2024 = "1719792000000000"  # 2024-07-01


# --- scans, projections, predicates -----------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
def scan_projection(spark, sf_dir):
    return scan.project(load(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice", "o_custkey"])


@query(f"WITH {EVENTS} SELECT event_id, user_id, ts_us, value FROM e WHERE event_type = 'purchase' AND value >= 10 AND value <= 50")
def filter_eq_range(spark, sf_dir):
    e = scan.equals(events(spark, sf_dir), event_type="purchase").filter(scan.in_range(F.col("value"), 10, 50))
    return scan.project(e, ["event_id", "user_id", "ts_us", "value"])


@query("SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'")
def filter_half_open_count(spark, sf_dir):
    start, end = F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))
    return load(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < end)).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50")
def head_ordered(spark, sf_dir):
    return scan.first_rows(scan.project(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice"]), 50, ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, printf('%.6f', value) AS value, CAST(user_id AS VARCHAR) AS user_id, event_type FROM events")
def column_as_text(spark, sf_dir):
    df = load(spark, sf_dir, "events").select("event_id", "value", "user_id", "event_type")
    return df.select("event_id", *[text.as_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields[1:]])


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events")
def type_filter(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    typed = e.withColumn("type_id", F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3))
    some = scan.of_type(typed, 1).unionByName(scan.of_type(typed, 2)).groupBy("event_type").agg(F.count("*").alias("n"))
    return some.unionByName(scan.of_type(typed, 0).agg(F.lit("all").alias("event_type"), F.count("*").alias("n")))


@query("SELECT s_suppkey, s_name FROM supplier")
def authorised_columns(spark, sf_dir):
    return scan.authorised(load(spark, sf_dir, "supplier"), ["s_suppkey", "s_name"])


@query("SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(DISTINCT user_id) FROM events) AS n_entities")
def row_and_entity_count(spark, sf_dir):
    a = load(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows"), F.lit(1).alias("k"))
    b = load(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("n_entities"), F.lit(1).alias("k"))
    return a.join(b, "k").drop("k")


@query("SELECT count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events)")
def multi_file_union(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return scan.union_files(spark, [path, path], strict=False).agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


# --- point-in-time lookups --------------------------------------------------------------------


@query(
    f"""WITH {EVENTS}, f AS (SELECT user_id, ts_us, max_by(event_id, event_id) AS feature_id, max_by(value, event_id) AS feature_value FROM e WHERE event_type = 'view' GROUP BY ALL),
s AS (SELECT event_id, user_id, ts_us FROM e WHERE event_type = 'purchase')
SELECT s.user_id, s.ts_us, s.event_id, f.ts_us AS feature_ts_us, f.feature_id, f.feature_value FROM s ASOF LEFT JOIN f ON s.user_id = f.user_id AND s.ts_us >= f.ts_us"""
)
def as_of_join(spark, sf_dir):
    e = events(spark, sf_dir)
    spine = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts_us")
    features = e.filter("event_type = 'view'").select("user_id", "ts_us", F.col("event_id").alias("feature_id"), F.col("value").alias("feature_value"))
    return asof.as_of_join(spine, features, "user_id", "ts_us", ["feature_id", "feature_value"], version="feature_id")


@query(
    f"""WITH {EVENTS}, c AS (SELECT (max(ts_us) + min(ts_us)) // 2 AS t FROM e), a AS (SELECT user_id, max_by(event_id, (ts_us, event_id)) AS event_id, max_by(ts_us, (ts_us, event_id)) AS ts_us FROM e, c WHERE ts_us <= t GROUP BY user_id),
q AS (SELECT c_custkey AS user_id, c_custkey % 7 AS position FROM customer UNION ALL SELECT c_custkey, 7 FROM customer WHERE c_custkey % 2 = 0)
SELECT q.user_id, position, event_id, ts_us FROM q JOIN a USING (user_id)"""
)
def as_of_batch(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "ts_us", "event_id")
    t = e.agg(F.floor((F.max("ts_us") + F.min("ts_us")) / 2).cast("long")).first()[0]
    c = load(spark, sf_dir, "customer")
    asked = c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 7).alias("position")).unionByName(c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(7).cast("long").alias("position")))
    return asof.as_of_batch(e, asked, "user_id", "ts_us", t, version="event_id").select("user_id", "position", "event_id", "ts_us")


@query(f"WITH {EVENTS} SELECT user_id, ts_us, event_id, event_type, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, event_id DESC) = 1")
def latest_per_entity(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "ts_us", "event_id", "event_type", "value")
    return asof.latest(e, "user_id", "ts_us", version="event_id")


@query(f"WITH {EVENTS}, r AS (SELECT min(ts_us) AS a, max(ts_us) AS b FROM e) SELECT user_id, ts_us, event_id, value FROM e, r WHERE user_id = (SELECT min(user_id) FROM e) AND ts_us BETWEEN a AND (a + b) // 2")
def history_range(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "ts_us", "event_id", "value")
    r = e.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), F.min("user_id").alias("u")).first()
    return asof.history(e, "user_id", r["u"], "ts_us", r["a"], (r["a"] + r["b"]) // 2, ["event_id"])


# --- keyed lookups, semi- and anti-joins -------------------------------------------------------

_CLASSES = "CASE s_nationkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END"


@query("SELECT n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def lookup_by_id(spark, sf_dir):
    region = lookups.by_id(load(spark, sf_dir, "region"), "r_name", "ASIA")
    n = load(spark, sf_dir, "nation")
    return n.join(lookups.small(region), n["n_regionkey"] == region["r_regionkey"]).select("n_name", "n_regionkey", "r_name")


@query("SELECT s_name AS field_name, coalesce(c, 0) AS classification, coalesce(2 * c, 0) AS sensitivity FROM supplier LEFT JOIN (SELECT n_nationkey, n_nationkey % 4 AS c FROM nation WHERE n_nationkey < 12) ON s_nationkey = n_nationkey")
def classification_lookup(spark, sf_dir):
    rules = load(spark, sf_dir, "nation").filter("n_nationkey < 12").select(F.col("n_nationkey").alias("rule_key"), (F.col("n_nationkey") % 4).alias("classification"), (F.col("n_nationkey") % 4 * 2).alias("sensitivity"))
    fields = load(spark, sf_dir, "supplier").select("s_name", F.col("s_nationkey").alias("rule_key"))
    return lookups.field_rules(fields, rules, "rule_key").select(F.col("s_name").alias("field_name"), "classification", "sensitivity")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_remaining(spark, sf_dir):
    steps = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step_id"))
    done = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("step_id"))
    return lookups.remaining_steps(steps, done, ["step_id"]).select(F.col("step_id").alias("c_custkey"))


@query(
    "SELECT l_orderkey AS order_key, l_linenumber AS line, CASE WHEN o_orderdate IS NULL THEN 'UNKNOWN_STEP' WHEN l_shipdate < o_orderdate THEN 'BAD_TIMES' WHEN sla = 0 OR (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000000 <= sla THEN 'MET' ELSE 'BREACHED' END AS status "
    "FROM lineitem LEFT JOIN (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 2592000 WHEN '2-HIGH' THEN 5184000 ELSE 0 END AS sla FROM orders) ON l_orderkey = o_orderkey"
)
def sla_breach(spark, sf_dir):
    sla = F.when(F.col("o_orderpriority") == "1-URGENT", 2592000).when(F.col("o_orderpriority") == "2-HIGH", 5184000).otherwise(0)
    steps = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step_id"), sla.cast("long").alias("sla_seconds"), (micros("o_orderdate") * 1000).alias("started_at_ns"))
    done = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("step_id"), F.col("l_linenumber").alias("line"), (micros("l_shipdate") * 1000).alias("completed_at_ns")).join(steps.select("step_id", "started_at_ns"), "step_id", "left")
    return lookups.checked_steps(done, steps).select(F.col("step_id").alias("order_key"), "line", "status")


@query(f"SELECT s_name AS column_name FROM supplier WHERE {_CLASSES} IN (2, 3) AND s_suppkey % 2 = 1")
def policy_violations(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    columns = s.select(F.col("s_name").alias("column_name"), F.expr(_CLASSES).alias("classification"))
    return lookups.policy_violations(columns, s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("column_name"))).select("column_name")


@query("SELECT count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) = 0 AS complete, (SELECT count(*) FROM orders) = (SELECT count(*) FROM customer) AS same_count FROM customer")
def all_steps_complete(spark, sf_dir):
    steps, done = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step_id")), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("step_id"))
    strict = lookups.all_complete(steps, done).withColumn("k", F.lit(1))
    return strict.join(lookups.all_complete(steps, done, strict=False).select(F.col("complete").alias("same_count"), F.lit(1).alias("k")), "k").drop("k")


@query("SELECT (SELECT count(*) FROM orders) AS decisions, (SELECT count(*) FROM lineitem) AS inferences, true AS chains_agree")
def cross_log_correlation(spark, sf_dir):
    d = load(spark, sf_dir, "orders").select(F.lit("chain-1").alias("chain_id"))
    return lookups.correlated(d, load(spark, sf_dir, "lineitem").select(F.lit("chain-1").alias("chain_id"))).select("decisions", "inferences", "chains_agree")


# --- aggregates --------------------------------------------------------------------------------


@query("SELECT min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value, count(l_extendedprice) AS num_values, count(*) FILTER (WHERE l_extendedprice IS NULL) AS null_count FROM lineitem")
def column_stats(spark, sf_dir):
    return aggregates.column_statistics(load(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("SELECT min(l_tax) AS min_value, max(l_tax) AS max_value, CAST(count(l_tax) AS BIGINT) AS num_values, CAST(0 AS BIGINT) AS null_count FROM lineitem")
def merged_statistics(spark, sf_dir):
    parts = load(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.min("l_tax").alias("min_value"), F.max("l_tax").alias("max_value"), F.count("l_tax").alias("num_values"), F.count_if(F.col("l_tax").isNull()).alias("null_count"))
    return aggregates.merge_statistics(parts)


_PERF = """WITH v AS (SELECT value AS x, value / 100.0 AS s FROM events WHERE value IS NOT NULL), b AS (SELECT count(*) AS n, avg(x) AS m, stddev_pop(x) AS d, avg(s) AS ms, count(*) FILTER (WHERE s < 0.5) AS low FROM v),
q AS (SELECT list_sort(list(x)) AS l FROM v)
SELECT n, round(m, 6) AS avg_latency, round(ms, 6) AS avg_score, low AS low_confidence, l[CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1] AS p50, l[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1] AS p95, l[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1] AS p99,
(SELECT count(*) FROM v WHERE x > m + 3 * d) AS anomalies FROM b, q"""


@query(_PERF)
def perf_summary(spark, sf_dir):
    v = load(spark, sf_dir, "events").filter("value is not null").select(F.col("value").alias("x"), (F.col("value") / 100.0).alias("s"))
    out = aggregates.performance_stats(v, "x", "s")
    return out.withColumns({"avg_latency": F.round("avg_latency", 6), "avg_score": F.round("avg_score", 6)})


@query("SELECT event_id, value FROM events, (SELECT avg(value) + 1.5 * stddev_pop(value) AS limit_ FROM events) WHERE value > limit_")
def anomaly_flags(spark, sf_dir):
    return aggregates.anomalies(load(spark, sf_dir, "events"), "value", 1.5).select("event_id", "value")


@query(
    "SELECT count(*) AS n, round(avg(s), 6) AS mean_score, round(quantile_cont(s, 0.5), 6) AS median_score, round(stddev_pop(s), 6) AS std_score, round(least(1.0, min(s)), 6) AS min_score, round(greatest(0.0, max(s)), 6) AS max_score, "
    "round(quantile_cont(value, 0.5), 6) AS p50_latency, round(quantile_cont(value, 0.95), 6) AS p95_latency, round(quantile_cont(value, 0.99), 6) AS p99_latency, count(DISTINCT event_type) AS versions FROM (SELECT *, value / 100.0 AS s FROM events)"
)
def art15_metrics(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("s", F.col("value") / 100.0)
    out = aggregates.accuracy_metrics(e, "s", "value", "event_type")
    return out.select([F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query("SELECT l_returnflag, list_sort(list(l_quantity))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95, list_sort(list(l_quantity))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS p50 FROM lineitem GROUP BY l_returnflag")
def lower_index_percentiles(spark, sf_dir):
    return aggregates.lower_percentiles(load(spark, sf_dir, "lineitem"), "l_quantity", {"p95": 0.95, "p50": 0.5}, ["l_returnflag"])


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def interpolated_percentile(spark, sf_dir):
    return aggregates.quantiles(load(spark, sf_dir, "lineitem"), "l_extendedprice", {"p90": 0.9}, ["l_returnflag"], interpolate=True).withColumn("p90", F.round("p90", 4))


@query(
    f"""WITH {EVENTS}, r AS (SELECT value AS v, row_number() OVER (ORDER BY ts_us, event_id) AS k FROM e), t AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi FROM r),
b AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 10)) AS INT), 9) AS bin, count(*) FILTER (WHERE k <= n // 2) AS a, count(*) FILTER (WHERE k > n // 2) AS c FROM r, t GROUP BY 1),
s AS (SELECT coalesce(a, 0) / (n // 2) + 1e-6 AS p, coalesce(c, 0) / (n - n // 2) + 1e-6 AS q FROM range(10) g(bin) CROSS JOIN t LEFT JOIN b USING (bin))
SELECT round(sum((p - q) * ln(p / q)), 6) AS psi FROM s"""
)
def psi_drift(spark, sf_dir):
    return aggregates.population_stability(events(spark, sf_dir), "value", ["ts_us", "event_id"]).select(F.round("psi", 6).alias("psi"))


@query("SELECT l_linenumber AS inference_type, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 0 AND 3 GROUP BY 1")
def type_distribution(spark, sf_dir):
    return aggregates.counts_by_type(load(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "inference_type"), "inference_type", 4)


@query(
    "SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS transitions FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders) WHERE i = 1 OR before IS DISTINCT FROM o_orderstatus GROUP BY o_custkey"
)
def transition_list(spark, sf_dir):
    return aggregates.transition_list(load(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderdate", "o_orderkey"], ["o_custkey"])


@query("SELECT arg_min(s, k) AS dataset_id, max(p) AS dataset_size FROM (SELECT nullif(CASE WHEN p_size < 10 THEN '' ELSE p_name END, '') AS s, p_partkey AS k, p_size AS p FROM part) WHERE true")
def training_data_first(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.when(F.col("p_size") < 10, "").otherwise(F.col("p_name")).alias("dataset_id"), "p_partkey", "p_size")
    first = aggregates.first_of(p, ["dataset_id"], ["p_partkey"]).withColumn("k", F.lit(1))
    return first.join(p.agg(F.max("p_size").alias("dataset_size"), F.lit(1).alias("k")), "k").drop("k")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS orders_new, count(*) FILTER (WHERE o_orderstatus = 'F') AS rejected, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS overrides FROM orders")
def conditional_counts(spark, sf_dir):
    return aggregates.count_where(load(spark, sf_dir, "orders"), orders_new=F.col("o_orderstatus") == "O", rejected=F.col("o_orderstatus") == "F", overrides=F.col("o_orderpriority") == "1-URGENT")


@query("SELECT event_type, count(*) AS decisions, sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) AS breaches FROM events GROUP BY event_type")
def breach_count(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("decisions"), F.count_if(~(F.col("value") >= 5)).alias("breaches"))


# --- windows -----------------------------------------------------------------------------------


@query(
    f"""WITH {EVENTS}, f AS (SELECT event_id, user_id % 40 AS u, ts_us // {DAY} * {DAY} AS t FROM e)
SELECT event_id, u, t, CAST(event_count AS BIGINT) AS event_count, event_count >= 10 AS alert FROM (SELECT *, count(*) OVER (PARTITION BY u ORDER BY t RANGE BETWEEN {7 * DAY} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY u, t) + row_number() OVER (PARTITION BY u, t ORDER BY event_id) AS event_count FROM f)"""
)
def sliding_rate(spark, sf_dir):
    f = events(spark, sf_dir).select("event_id", (F.col("user_id") % 40).alias("u"), (F.floor(F.col("ts_us") / DAY) * DAY).alias("t"))
    return windows.sliding_rate_bucketed(f, "t", 7 * DAY, "event_id", ["u"])


@query(
    f"""WITH {EVENTS} SELECT event_id, CAST(count(*) OVER (ORDER BY ts_us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY ts_us) + row_number() OVER (PARTITION BY ts_us ORDER BY event_id) AS BIGINT) AS event_count FROM e"""
)
def sliding_rate_one_stream(spark, sf_dir):
    return windows.sliding_rate_bucketed(events(spark, sf_dir).select("event_id", "ts_us"), "ts_us", HOUR, "event_id").select("event_id", "event_count")


@query(f"WITH {EVENTS}, m AS (SELECT max(ts_us) AS now_ FROM e) SELECT count(*) AS event_count FROM e, m WHERE ts_us BETWEEN now_ - {30 * DAY} AND now_")
def window_count_at(spark, sf_dir):
    e = events(spark, sf_dir)
    return windows.count_at(e, "ts_us", e.agg(F.max("ts_us")).first()[0], 30 * DAY)


@query(f"WITH {EVENTS} SELECT user_id, gap_start, gap_end FROM (SELECT user_id, lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us) AS gap_start, ts_us AS gap_end FROM e) WHERE gap_end - gap_start > {20 * DAY}")
def completeness_gaps(spark, sf_dir):
    return windows.gaps(events(spark, sf_dir), "ts_us", 20 * DAY, ["user_id"])


# --- chains --------------------------------------------------------------------------------------


def _order_chains(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("chain"), "o_orderkey", (micros("o_orderdate") * 1000).alias("ts_ns"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").cast("binary").alias("data"))
    return chain.create(o, "chain", ["ts_ns", "o_orderkey"], "ts_ns", "data")


@query("SELECT o_custkey % 50 AS chain, count(*) AS entries, true AS valid FROM orders GROUP BY 1")
def chain_verify(spark, sf_dir):
    return chain.verify(_order_chains(spark, sf_dir), ["chain"], "ts_ns", "data").select("chain", "entries", "valid")


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey % 50 AS chain, epoch_us(o_orderdate) * 1000 AS ts, o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority) AS d, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders),
le AS (SELECT *, list_aggregate(list_transform(generate_series(7, 0, -1), lambda k: lpad(to_hex(i), 16, '0')[2 * k + 1 : 2 * k + 2]), 'string_agg', '') AS si, list_aggregate(list_transform(generate_series(7, 0, -1), lambda k: lpad(to_hex(ts), 16, '0')[2 * k + 1 : 2 * k + 2]), 'string_agg', '') AS st FROM o),
c AS (SELECT chain, i, sha256(unhex(si || st || repeat('0', 64) || d)) AS h FROM le WHERE i = 0 UNION ALL SELECT le.chain, le.i, sha256(unhex(si || st || h || d)) FROM c JOIN le ON le.chain = c.chain AND le.i = c.i + 1)
SELECT chain, max(i) AS last_seq, max_by(h, i) AS last_hash FROM c GROUP BY chain"""
)
def chain_segments(spark, sf_dir):
    return chain.segment_metadata(_order_chains(spark, sf_dir).withColumn("file", F.lit("one")), "file", ["chain"]).select("chain", "last_seq", "last_hash")


@query("SELECT o_custkey % 50 AS chain, count(*) > 20 AS split_, true AS continuous FROM orders GROUP BY 1")
def chain_continuity(spark, sf_dir):
    rows = _order_chains(spark, sf_dir).withColumn("file", F.floor(F.col("chain_seq") / 20))
    parts = chain.continuity(chain.segment_metadata(rows, "file", ["chain"]), ["chain"])
    return parts.groupBy("chain").agg((F.count("*") > 1).alias("split_"), F.every("continuous").alias("continuous"))


@query("SELECT sha256(s_name) AS h, lower(hex(s_name::BLOB)) AS x, s_suppkey FROM supplier")
def hash_functions(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select(hashing.sha256(F.col("s_name")).alias("h"), hashing.to_hex(F.col("s_name").cast("binary")).alias("x"), "s_suppkey")


@query("SELECT c_custkey, true AS may_contain FROM customer")
def bloom_membership(spark, sf_dir):
    c = load(spark, sf_dir, "customer").withColumn("name", F.col("c_name"))
    blocks = hashing.bloom_blocks(20_000, 0.01)
    return hashing.bloom_probe(c, "name", hashing.bloom_build(c, "name", blocks), blocks).select("c_custkey", "may_contain")


@query("SELECT n_nationkey, round(pow(1 - exp(-8.0 * (n_nationkey * 100) / (256.0 * 64)), 8), 9) AS fpr FROM nation")
def bloom_fpr(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", F.round(hashing.bloom_estimated_fpr(F.col("n_nationkey") * 100, 64), 9).alias("fpr"))


# --- scalars -------------------------------------------------------------------------------------

_DIGITS = "list_aggregate(list_transform(string_split(code, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), 'string_agg', '')"
_CODES = "SELECT s_suppkey, 'XX' || lpad(CAST(s_suppkey * 7919 AS VARCHAR), 10, '0') AS isin, '5493' || lpad(CAST(s_suppkey * 104729 AS VARCHAR), 16, '0') AS lei, CASE WHEN s_suppkey % 3 = 0 THEN 'XNYS' ELSE 'xn' || s_suppkey END AS mic FROM supplier"


@query(
    f"""WITH s AS ({_CODES}), i AS (SELECT *, list_reverse(string_split({_DIGITS.replace('code', 'isin')}, '')) AS r, string_split({_DIGITS.replace('code', 'lei')}, '') AS n FROM s)
SELECT s_suppkey, list_sum(list_transform(r, lambda d, k: CASE WHEN k % 2 = 1 THEN CAST(d AS INT) WHEN CAST(d AS INT) > 4 THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END)) % 10 = 0 AS isin_ok,
list_reduce(list_transform(n, lambda d: CAST(d AS BIGINT)), lambda a, d: (a * 10 + d) % 97) = 1 AS lei_ok, regexp_full_match(mic, '[A-Z]{{4}}') AS mic_ok FROM i"""
)
def identifier_validation(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    codes = s.select(
        "s_suppkey",
        F.concat(F.lit("XX"), F.lpad((F.col("s_suppkey") * 7919).cast("string"), 10, "0")).alias("isin"),
        F.concat(F.lit("5493"), F.lpad((F.col("s_suppkey") * 104729).cast("string"), 16, "0")).alias("lei"),
        F.when(F.col("s_suppkey") % 3 == 0, "XNYS").otherwise(F.concat(F.lit("xn"), F.col("s_suppkey").cast("string"))).alias("mic"),
    )
    return codes.select("s_suppkey", validators.validate_isin(F.col("isin")).alias("isin_ok"), validators.validate_lei(F.col("lei")).alias("lei_ok"), validators.validate_mic(F.col("mic")).alias("mic_ok"))


@query(
    """SELECT o_orderkey, CASE WHEN 100.0 * abs(o_totalprice - ref) / ref > 80 THEN 'PRICE_COLLAR' WHEN o_totalprice > 300000 THEN 'MAX_ORDER_SIZE' WHEN daily + o_totalprice > 500000 THEN 'MAX_DAILY_VOLUME' ELSE 'PASS' END AS verdict
FROM (SELECT o_orderkey, o_totalprice, 150000.0 AS ref, coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100.0 AS daily FROM orders)"""
)
def pre_trade_check(spark, sf_dir):
    from pyspark.sql import Window

    before = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    o = load(spark, sf_dir, "orders").withColumn("daily", F.coalesce(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(before), F.lit(0)) / 100.0)
    return o.select("o_orderkey", validators.pre_trade_check(F.col("o_totalprice"), F.lit(150000.0), F.col("o_totalprice"), F.col("daily"), 80, 300000, 500000).alias("verdict"))


@query("SELECT o_orderkey, CASE WHEN age > 9000 THEN 'DELETE' WHEN age > 8000 THEN 'ARCHIVE' ELSE 'ACTIVE' END AS retention FROM (SELECT o_orderkey, (epoch_us(TIMESTAMP '2020-01-01') - epoch_us(o_orderdate)) / 86400000000 AS age FROM orders)")
def retention_class(spark, sf_dir):
    age = (F.lit(1577836800000000) - micros("o_orderdate")) * 1000
    return load(spark, sf_dir, "orders").select("o_orderkey", governance.retention_class(age, 9000 * validators.DAY_NS, 8000 * validators.DAY_NS).alias("retention"))


@query("SELECT retention, count(*) AS files, CAST(sum(o_orderkey) AS BIGINT) AS bytes FROM (SELECT o_orderkey, CASE WHEN age > 9000 THEN 'DELETE' WHEN age > 8000 THEN 'ARCHIVE' ELSE 'ACTIVE' END AS retention FROM (SELECT o_orderkey, (epoch_us(TIMESTAMP '2020-01-01') - epoch_us(o_orderdate)) / 86400000000 AS age FROM orders)) GROUP BY 1")
def retention_summary(spark, sf_dir):
    files = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), ((F.lit(1577836800000000) - micros("o_orderdate")) * 1000).alias("age_ns"), F.col("o_orderkey").alias("size_bytes"))
    return governance.retention_summary(governance.retention_plan(files, 9000 * validators.DAY_NS, 8000 * validators.DAY_NS))


_THREATS = "SELECT p_partkey, p_size % 11 AS a, p_size % 7 + 2 AS b, p_size % 10 + 1 AS c, p_size % 5 + 5 AS d, p_size % 9 + 1 AS e, p_size % 5 AS category, p_partkey % 4 AS s1, p_size % 5 AS s2 FROM part"


@query(
    f"""WITH t AS (SELECT *, (a + b + c + d + e) / 5.0 AS score, a BETWEEN 1 AND 10 AS ok, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE least(s1, s2) END AS status FROM ({_THREATS}))
SELECT count(*) AS total, count(*) FILTER (WHERE ok AND score >= 9) AS critical, count(*) FILTER (WHERE ok AND score >= 7 AND score < 9) AS high, count(*) FILTER (WHERE ok AND score >= 4 AND score < 7) AS medium, count(*) FILTER (WHERE ok AND score < 4) AS low,
count(*) FILTER (WHERE ok AND status >= 2) AS mitigated, count(*) FILTER (WHERE ok AND status < 2) AS unmitigated, round(avg(score) FILTER (WHERE ok), 6) AS mean_score, 6 - count(DISTINCT category) FILTER (WHERE ok) AS n_missing, count(DISTINCT category) FILTER (WHERE ok) = 6 AS complete FROM t"""
)
def threat_model_rollup(spark, sf_dir):
    t = load(spark, sf_dir, "part").selectExpr(
        "p_size % 5 AS category", "named_struct('damage', p_size % 11, 'reproducibility', p_size % 7 + 2, 'exploitability', p_size % 10 + 1, 'affected_users', p_size % 5 + 5, 'discoverability', p_size % 9 + 1) AS dread",
        "CASE WHEN p_partkey % 6 = 0 THEN array() ELSE array(named_struct('status', cast(p_partkey % 4 AS int)), named_struct('status', p_size % 5)) END AS mitigations",
    )
    out = governance.threat_summary(t)
    return out.select("total", "critical", "high", "medium", "low", "mitigated", "unmitigated", F.round("mean_score", 6).alias("mean_score"), F.size("missing_categories").cast("long").alias("n_missing"), "complete")


@query("SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS pending, count(*) FILTER (WHERE o_totalprice >= 200000) AS high_impact FROM orders")
def regulatory_pending(spark, sf_dir):
    changes = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", 4).otherwise(1).alias("status"), F.floor(F.col("o_totalprice") / 100000).alias("impact"))
    a = governance.pending_changes(changes).agg(F.count("*").alias("pending"), F.lit(1).alias("k"))
    return a.join(governance.changes_with_impact(changes, 2).agg(F.count("*").alias("high_impact"), F.lit(1).alias("k")), "k").drop("k")


@query(
    """SELECT s_suppkey, CASE WHEN c IN (2, 3) AND s_suppkey % 2 = 0 THEN 'ENCRYPTION_REQUIRED' WHEN c = 3 AND s_suppkey % 3 = 0 THEN 'PSEUDONYMISATION_REQUIRED' WHEN c > 0 AND s_suppkey % 5 = 0 THEN 'PURPOSE_NOT_ALLOWED' ELSE 'OK' END AS verdict,
s_acctbal < 0 OR s_suppkey % 4 = 0 AS due FROM (SELECT *, s_nationkey % 4 AS c FROM supplier)"""
)
def handling_rules(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").withColumn("c", F.col("s_nationkey") % 4)
    k = F.col("s_suppkey")
    verdict = validators.validate_handling(
        F.col("c"), validators.requires_encryption(F.col("c")), F.col("c") == 3, F.when(F.col("c") > 0, F.array(F.lit("audit"))).otherwise(F.array().cast("array<string>")), k % 2 != 0, k % 3 != 0, F.when(k % 5 == 0, "marketing").otherwise("audit")
    )
    rotation = validators.needs_rotation(F.when(k % 4 == 0, "ACTIVE").otherwise("RETIRED"), F.lit(1), F.lit(2))
    return s.select("s_suppkey", verdict.alias("verdict"), (rotation | (F.col("s_acctbal") < 0)).alias("due"))


@query(f"WITH {EVENTS} SELECT event_id, ts_us > {MID_2024} AS recent, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((ts_us * 1000) % 1000000000 AS VARCHAR), 9, '0') || 'Z' AS iso9, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || '.' || left(lpad(CAST((ts_us * 1000) % 1000000000 AS VARCHAR), 9, '0'), 3) || 'Z' AS iso3 FROM e")
def iso_timestamps(spark, sf_dir):
    e = events(spark, sf_dir)
    ns = F.col("ts_us") * 1000
    return e.select("event_id", (F.col("ts_us") > int(MID_2024)).alias("recent"), text.iso8601(ns).alias("iso9"), text.iso8601(ns, 3).alias("iso3"))


@query("SELECT event_id, to_base64(props::BLOB) AS payload, props AS back FROM events")
def payload_base64(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", codecs.encode_payload(F.col("props")).alias("payload"), codecs.decode_payload(codecs.encode_payload(F.col("props"))).cast("string").alias("back"))


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 4) AS l2, round(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]), 4) AS squares FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) b")
def vector_distances(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    one = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    both = e.join(F.broadcast(one), F.lit(True))  # one row
    return both.select("vec_id", F.round(vectors.dot_product(F.col("embedding"), F.col("q")), 4).alias("dot"), F.round(vectors.l2_distance_sq(F.col("embedding"), F.col("q")), 4).alias("l2"), F.round(vectors.sum_of_squares(F.col("embedding")), 4).alias("squares"))


@query(
    """WITH r AS (SELECT max(greatest(abs(list_min(embedding)::DOUBLE), abs(list_max(embedding)::DOUBLE))) / 127 AS s FROM embeddings)
SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(greatest(-127, least(127, round_even(x / s, 0))) AS INT)) AS q, list_transform(embedding::DOUBLE[], lambda x: round(CAST(greatest(-127, least(127, round_even(x / s, 0))) AS INT) * s, 4)) AS back FROM embeddings, r"""
)
def quantize_int8(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    scale = vectors.finite_range(e, "embedding").select(vectors.scale_symmetric(F.col("lo"), F.col("hi")).alias("s"))
    q = e.join(F.broadcast(scale), F.lit(True)).select("vec_id", "s", vectors.quantize_int8(F.col("embedding"), F.col("s")).alias("q"))  # one row
    return q.select("vec_id", "q", F.transform(vectors.dequantize(F.col("q"), F.col("s")), lambda x: F.round(x, 4)).alias("back"))


@query(
    """WITH r AS (SELECT min(list_min(embedding)::DOUBLE) AS z, (max(list_max(embedding)::DOUBLE) - min(list_min(embedding)::DOUBLE)) / 255 AS s FROM embeddings)
SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(greatest(0, least(255, round_even((x - z) / s, 0))) AS INT)) AS q FROM embeddings, r"""
)
def quantize_uint8(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    r = vectors.finite_range(e, "embedding").select(F.col("lo").alias("z"), ((F.col("hi") - F.col("lo")) / 255).alias("s"))
    return e.join(F.broadcast(r), F.lit(True)).select("vec_id", vectors.quantize_uint8(F.col("embedding"), F.col("s"), F.col("z")).alias("q"))  # one row


@query(
    """WITH r AS (SELECT max(greatest(abs(list_min(embedding)::DOUBLE), abs(list_max(embedding)::DOUBLE))) / 7 AS s FROM embeddings),
q AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(greatest(-7, least(7, round_even(x / s, 0))) AS INT)) AS q FROM embeddings, r)
SELECT vec_id, q AS back, list_aggregate(list_transform(q, lambda v: substr('0123456789abcdef', CAST((v + 16) % 16 AS BIGINT) + 1, 1)), 'string_agg', '') AS packed FROM q"""
)
def quantize_int4(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    scale = vectors.finite_range(e, "embedding").select(vectors.scale_symmetric(F.col("lo"), F.col("hi"), 7).alias("s"))
    packed = e.join(F.broadcast(scale), F.lit(True)).select("vec_id", F.size("embedding").alias("n"), vectors.quantize_int4(F.col("embedding"), F.col("s")).alias("p"))  # one row
    return packed.select("vec_id", F.transform(vectors.dequantize_int4(F.col("p"), F.col("n"), F.lit(1)), lambda x: x.cast("int")).alias("back"), F.lower(F.hex("p")).alias("packed"))


@query("SELECT l_orderkey, l_linenumber, [l_quantity, l_extendedprice, l_discount, l_tax] AS row_, [l_extendedprice, l_discount] AS slice_ FROM lineitem")
def tensor_assembly(spark, sf_dir):
    row = vectors.assemble(*[F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", row.alias("row_")).withColumn("slice_", vectors.slice_rows(F.col("row_"), 1, 1, 2))


@query("SELECT vec_id, list_transform(generate_series(0, 7), lambda i: embedding[8 * i + 1 : 8 * i + 8]) AS matrix FROM embeddings")
def tensor_reshape(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", vectors.reshape(F.col("embedding"), 8).alias("matrix"))


@query(
    """SELECT l_orderkey, l_linenumber, (SELECT CAST(sum(((l_orderkey >> i) & 1) << (2 * i)) + sum(((l_partkey >> i) & 1) << (2 * i + 1)) AS BIGINT) FROM range(30) g(i)) AS z, l_orderkey AS x, l_partkey AS y FROM lineitem"""
)
def zorder_key(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", keys.morton_2d(F.col("l_orderkey"), F.col("l_partkey")).alias("z"))
    x, y = keys.deinterleave_2d(F.col("z"))
    return df.select("l_orderkey", "l_linenumber", "z", x.alias("x"), y.alias("y"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem")
def zorder_sort(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return layout.z_order(df, F.col("l_orderkey"), F.col("l_partkey"))


@query("SELECT s_suppkey, CAST(s_nationkey AS BIGINT) + 2147483648 AS k32, CAST('0x' || rpad(left(hex(s_name::BLOB), 8), 8, '0') AS BIGINT) AS ks FROM supplier")
def order_keys(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", keys.normalize_int32(F.col("s_nationkey")).alias("k32"), keys.normalize_string(F.col("s_name")).alias("ks"))


# --- reports -------------------------------------------------------------------------------------


def _decisions(spark, sf_dir) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(
        (micros("o_orderdate") * 1000).alias("timestamp_ns"), F.col("o_orderkey").alias("chain_seq"), (F.col("o_custkey") % 9).cast("int").alias("strategy_id"), F.lit("v1").alias("model_version"),
        F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 6).otherwise(0).alias("decision_type"), F.round("o_totalprice", 2).alias("model_output"), F.lit(0.5).alias("confidence"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("risk_result"), F.col("o_orderkey").cast("string").alias("order_id"), F.concat(F.lit("S,"), F.col("o_orderstatus")).alias("symbol"),
        F.round("o_totalprice", 2).alias("price"), F.lit(3.0).alias("quantity"), F.lit("XNYS").alias("venue"), F.lit(0).alias("buy_sell"), F.lit(1).alias("order_type"), F.lit(99).alias("time_in_force"),
        F.lit("").alias("isin"), F.lit("USD").alias("currency"), F.lit(False).alias("short_selling_flag"), F.lit(True).alias("aggregated_order"), F.lit("").alias("parent_order_id"),
    )


_TYPE = "CASE o_orderstatus WHEN 'O' THEN 'ORDER_NEW' WHEN 'F' THEN 'RISK_OVERRIDE' ELSE 'SIGNAL' END"
_RISK = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'REJECTED' ELSE 'PASSED' END"
_PRICE = "regexp_replace(regexp_replace(printf('%.2f', round(o_totalprice, 2)), '0+$', ''), '\\.$', '')"
_ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000000000Z'"


@query(f"""SELECT epoch_us(o_orderdate) * 1000 AS timestamp_ns, o_orderkey AS chain_seq, {_ISO} || ',' || o_orderkey || ',FIRM,' || o_custkey % 9 || ',v1,"S,' || o_orderstatus || '",XNYS,' || {_TYPE} || ',' || {_PRICE} || ',3,' || {_RISK} || ',' || {_PRICE} || ',0.5,BUYI,LIMIT,OTHER,,USD,false,true,,,' AS line FROM orders""")
def mifid_csv(spark, sf_dir):
    return reports.transaction_report(_decisions(spark, sf_dir), "csv", firm_id="FIRM")


@query(
    f"""SELECT epoch_us(o_orderdate) * 1000 AS timestamp_ns, o_orderkey AS chain_seq, '{{"ts":"' || {_ISO} || '","order_id":"' || o_orderkey || '","algo":"' || o_custkey % 9 || '","model":"v1","instrument":"S,' || o_orderstatus || '","venue":"XNYS","type":"' || {_TYPE} || '","price":' || {_PRICE} || ',"qty":3,"risk_gate":"' || {_RISK} || '","output":' || {_PRICE} || ',"conf":0.5,"buy_sell":"BUYI","order_type":"LIMIT","tif":"OTHER","isin":"","ccy":"USD","short_sell":false,"aggregated":true}}' AS line FROM orders"""
)
def mifid_ndjson(spark, sf_dir):
    return reports.transaction_report(_decisions(spark, sf_dir), "ndjson")


@query(
    "SELECT count(*) AS decisions, count(*) FILTER (WHERE o_orderstatus = 'O') AS orders_new, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS rejected, count(*) FILTER (WHERE o_orderstatus = 'F') AS overrides, min(epoch_us(o_orderdate)) * 1000 AS first_ns, max(epoch_us(o_orderdate)) * 1000 AS last_ns, "
    "(SELECT count(*) FROM events) AS inferences, (SELECT CAST(floor(avg(CAST(event_id % 1000 AS BIGINT))) AS BIGINT) FROM events) AS avg_latency_ns, (SELECT round(avg(value), 6) FROM events) AS avg_score, (SELECT count(DISTINCT event_type) FROM events) AS model_versions FROM orders"
)
def record_keeping(spark, sf_dir):
    i = events(spark, sf_dir).select((F.col("ts_us") * 1000).alias("timestamp_ns"), (F.col("event_id") % 1000).alias("latency_ns"), F.col("value").alias("output_score"), F.col("event_type").alias("model_version"))
    return reports.record_keeping(_decisions(spark, sf_dir), i).withColumn("avg_score", F.round("avg_score", 6))


def _inferences(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        (F.col("ts_us") * 1000).alias("timestamp_ns"), (F.col("event_id") % 8).cast("int").alias("inference_type"), (F.col("value") / 100).alias("output_score"), (F.col("event_id") % 1000).alias("latency_ns"),
        F.lit(2).alias("batch_size"), (F.col("event_id") % 10).cast("int").alias("input_tokens"), F.lit(5).alias("output_tokens"), F.lit("chain-1").alias("chain_id"),
    )


@query(
    "SELECT count(*) AS inferences, round(avg(value / 100), 6) AS avg_score, CAST(floor(avg(CAST(event_id % 1000 AS BIGINT))) AS BIGINT) AS avg_latency_ns, count(*) FILTER (WHERE value / 100 < 0.5) AS low_confidence, CAST(sum(event_id % 10) AS BIGINT) AS input_tokens, CAST(5 * count(*) AS BIGINT) AS output_tokens, "
    "CAST(2 * count(*) AS BIGINT) AS batch_total, " + ", ".join(f"count(*) FILTER (WHERE event_id % 8 = {t}) AS type_{t}" for t in range(8)) + " FROM events"
)
def transparency_report(spark, sf_dir):
    return reports.transparency(_inferences(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 6))


@query("SELECT (SELECT count(*) FROM orders) AS decisions, count(*) AS inferences, 'chain-1' AS chain_a, 'chain-1' AS chain_b, true AS chains_agree, CAST(0 AS BIGINT) AS anomalies FROM events")
def conformity_report(spark, sf_dir):
    return reports.conformity(_decisions(spark, sf_dir).withColumn("chain_id", F.lit("chain-1")), _inferences(spark, sf_dir))


@query("SELECT c_custkey, c_name, c_acctbal, true AS hidden FROM customer")
def column_encryption(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    keyed = security.column_keys(b"master key of the test", {"c_custkey": 0, "c_name": 2, "c_acctbal": 3})
    sealed = security.encrypt_columns(c, keyed).withColumn("hidden", ~F.decode("c_name", "ISO-8859-1").contains("Customer"))
    return security.decrypt_columns(sealed, keyed, {"c_acctbal": "double"})


@query("SELECT s_suppkey, s_nationkey AS subject, CASE WHEN s_nationkey % 2 = 0 THEN s_name END AS s_name FROM supplier")
def crypto_shredding(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("subject"), "s_name")
    subject_keys = s.select("subject").distinct().withColumn("subject_key", F.unhex(F.sha2(F.concat(F.lit("test key "), F.col("subject").cast("string")), 256)))
    sealed = security.seal(s, subject_keys, "s_name")
    return security.unseal(sealed, security.shred(subject_keys, s.filter("subject % 2 = 1").select("subject").distinct()), "s_name").select("s_suppkey", "subject", "s_name")


# --- streams and codecs ----------------------------------------------------------------------------


@query(
    f"""WITH {EVENTS}, r AS (SELECT ts_us * 1000 AS timestamp_ns, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS type_id, props AS payload FROM e), b AS (SELECT min(timestamp_ns) AS lo, max(timestamp_ns) AS hi FROM r)
SELECT timestamp_ns, type_id, payload FROM r, b WHERE type_id = 2 AND timestamp_ns BETWEEN lo AND lo + (hi - lo) // 2"""
)
def hybrid_read(spark, sf_dir):
    from ..sources import logs

    e = events(spark, sf_dir)
    records = e.select((F.col("ts_us") * 1000).alias("timestamp_ns"), F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3).alias("type_id"), F.base64(F.col("props").cast("binary")).alias("payload"), "event_id")
    lo, hi = records.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    closed, live = (records.filter(c).drop("event_id") for c in ("event_id % 3 <> 0", "event_id % 3 = 0"))
    out = logs.hybrid_read(spark, closed, live, lo, lo + (hi - lo) // 2, 2)
    return out.withColumn("payload", F.col("payload").cast("string"))


@query("SELECT n_nationkey, 'int8' AS scheme, CAST(n_nationkey AS VARCHAR) AS dimension, '[' || n_nationkey || ',' || n_regionkey || ']' AS as_json, [n_nationkey, n_regionkey] AS parsed FROM nation")
def parameter_codecs(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    params = vectors.parse_quantization_params(vectors.quantization_params("int8", F.lit(0.5), F.lit(0.0), F.col("n_nationkey")))
    features = codecs.features_to_json(F.array("n_nationkey", "n_regionkey"))
    return n.select("n_nationkey", params["scheme"].alias("scheme"), params["dimension"].alias("dimension"), features.alias("as_json"), codecs.features_from_json(features, "array<int>").alias("parsed"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '\"a,' || n_name || '\"' ELSE n_name END AS field, CASE n_regionkey WHEN 0 THEN 'BUYI' WHEN 1 THEN 'SELL' WHEN 2 THEN 'SSEX' ELSE 'UNKNOWN' END AS label, CAST(coalesce(try_cast(regexp_extract(n_nationkey || 'abc', '^-?\\d+') AS BIGINT), 0) AS BIGINT) AS parsed FROM nation")
def report_fields(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    field = text.csv_field(F.when(F.col("n_regionkey") == 0, F.concat(F.lit("a,"), F.col("n_name"))).otherwise(F.col("n_name")))
    return n.select("n_nationkey", field.alias("field"), text.label_of(F.col("n_regionkey"), reports.BUY_SELL).alias("label"), text.lenient_long(F.concat(F.col("n_nationkey").cast("string"), F.lit("abc"))).alias("parsed"))


@query("SELECT o_orderkey, (epoch_us(TIMESTAMP '2020-01-01') - epoch_us(o_orderdate)) // 1000000 <= 800000000 AS meets_rpo, o_orderkey % 5 <> 0 AND epoch_us(TIMESTAMP '2020-01-01') - epoch_us(o_orderdate) > 9000 * 86400000000 AS expired, o_totalprice / 1000000 > 0.25 AS drifted, abs(o_orderkey % 7 - 3) * 500000 <= 1000000 AS in_sync FROM orders")
def yes_no_rules(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    now, then = F.lit(1577836800000000000), micros("o_orderdate") * 1000
    return o.select(
        "o_orderkey", validators.meets_rpo(now, then, F.lit(800000000)).alias("meets_rpo"), validators.is_expired(then, now, F.lit(9000), F.col("o_orderkey") % 5 == 0).alias("expired"),
        validators.is_drifted(F.col("o_totalprice") / 1000000).alias("drifted"), validators.clock_in_sync((F.col("o_orderkey") % 7 - 3) * 500000).alias("in_sync"),
    )
