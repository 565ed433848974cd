"""Statistics, percentiles, drift and report figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch

def column_statistics(df: DataFrame, column: str) -> DataFrame:
    """min, max, values and nulls; NaN is passed over and not counted."""
    kind = dict(df.dtypes)[column]
    value = F.col(column)
    seen = F.when(~F.isnan(value), value) if kind in ("double", "float") else value
    return df.agg(F.min(seen).alias("min_value"), F.max(seen).alias("max_value"), F.count(seen).alias("num_values"), F.count_if(value.isNull()).alias("null_count"))


def merge_statistics(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Statistics of a whole from those of its parts."""
    grouped = parts.groupBy(*(by or []))
    return grouped.agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("num_values").alias("num_values"), F.sum("null_count").alias("null_count"))


#: Bins over the values by which order statistics are found: only those that hold a wanted place are sorted.
BINS = 64


def _bin_of(value: Column, points: list) -> Column:
    """The number of points below the value, by a tree of comparisons."""
    if not points:
        return F.lit(0)
    middle = len(points) // 2
    low, high = _bin_of(value, points[:middle]), _bin_of(value, points[middle + 1 :])
    return F.when(value <= F.lit(points[middle]), low).otherwise(high + (middle + 1))


def quantiles(df: DataFrame, column: str, points: dict[str, float], by: list[str] | None = None, interpolate: bool = False) -> DataFrame:
    """For each point p the value at place p * (n - 1) of the sorted values, of each group: at its whole part, or between its two neighbours.

    Values are counted first, so equal values meet in one row. Approximate quantiles cut them into bins, whose counts
    tell which bin holds a place; running counts are taken inside these bins only. No task holds a group or the whole,
    and nothing is gathered in a list. The result is exact. Nulls do not count.
    """
    by = by or []
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v_")).count()
    cuts = counted.select(F.percentile_approx("v_", [i / BINS for i in range(1, BINS)], 1000)).first()[0] or []
    binned = counted.withColumn("bin_", _bin_of(F.col("v_"), sorted(set(cuts))))
    totals = binned.groupBy(*by, "bin_").agg(F.sum("count").alias("in_"))  # BINS rows a group at most
    whole = Window.partitionBy(*by)
    placed = totals.select(*by, "bin_", "in_", (F.sum("in_").over(whole.orderBy("bin_")) - F.col("in_")).alias("before_"), F.sum("in_").over(whole).alias("n_"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.lit(k).alias("k")) for name, p in points.items() for k in ((0, 1) if interpolate else (0,))])).alias("w")
    place = F.least(F.floor(F.col("w.p") * (F.col("n_") - 1)) + F.col("w.k"), F.col("n_") - 1)
    asked = placed.select("*", wanted).withColumn("place_", place).filter((F.col("place_") >= F.col("before_")) & (F.col("place_") < F.col("before_") + F.col("in_")))
    asked = asked.select(*by, "bin_", F.col("w.name").alias("name_"), F.col("w.k").alias("k_"), (F.col("place_") - F.col("before_")).alias("at_"), (F.col("w.p") * (F.col("n_") - 1) - F.floor(F.col("w.p") * (F.col("n_") - 1))).alias("part_"))
    running = F.sum("count").over(Window.partitionBy(*by, "bin_").orderBy("v_"))
    left, right = binned.alias("l"), asked.select(*[F.col(c).alias(f"a{i}_") for i, c in enumerate(by)], F.col("bin_").alias("b_"), "name_", "k_", "at_", "part_").alias("r")
    same = F.col("bin_") == F.col("b_")
    for i, c in enumerate(by):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"a{i}_"))
    keys = right.select(*[f"a{i}_" for i in range(len(by))], "b_").distinct()
    some = left.join(keys, same, "left_semi").withColumn("upto_", running)
    found = some.alias("l").join(right, same & (F.col("upto_") > F.col("at_")) & (F.col("upto_") - F.col("count") <= F.col("at_")))
    values = [F.max(F.when((F.col("name_") == name) & (F.col("k_") == k), F.col("v_"))) for name in points for k in ((0, 1) if interpolate else (0,))]
    if not interpolate:
        return found.groupBy(*[F.col(f"l.{c}").alias(c) for c in by]).agg(*[v.alias(name) for name, v in zip(points, values, strict=True)])
    parts = [F.max(F.when(F.col("name_") == name, F.col("part_"))) for name in points]
    return found.groupBy(*[F.col(f"l.{c}").alias(c) for c in by]).agg(*[((1 - part) * values[2 * i] + part * values[2 * i + 1]).alias(name) for i, (name, part) in enumerate(zip(points, parts, strict=True))])


def lower_percentiles(df: DataFrame, column: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """For each point p the value at place floor(p * (n - 1)) of the sorted values, of each group."""
    return quantiles(df, column, points, by)


def performance_stats(df: DataFrame, latency: str, score: str, low: float = 0.5, points: dict[str, float] | None = None) -> DataFrame:
    """Counts, means, lower-index percentiles of latency, scores under ``low``, latencies over mean + 3 deviations."""
    points = points or {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    base = df.agg(F.count("*").alias("n"), F.avg(latency).alias("avg_latency"), F.stddev_pop(latency).alias("sd"), F.avg(score).alias("avg_score"), F.count_if(F.col(score) < low).alias("low_confidence"))
    over = df.join(F.broadcast(base.select("avg_latency", "sd")), F.col(latency) > F.col("avg_latency") + 3 * F.col("sd")).agg(F.count("*").alias("anomalies"))  # one row is broadcast
    one = lambda d: d.withColumn("k_", F.lit(1))
    return one(base).join(one(lower_percentiles(df, latency, points)), "k_").join(one(over), "k_").drop("k_", "sd")


def anomalies(df: DataFrame, column: str, sigmas: float = 3.0) -> DataFrame:
    """Rows whose value exceeds the mean by so many population deviations."""
    limit = df.agg((F.avg(column) + sigmas * F.stddev_pop(column)).alias("limit_"))
    return df.join(F.broadcast(limit), F.col(column) > F.col("limit_")).drop("limit_")  # one row is broadcast


def accuracy_metrics(df: DataFrame, score: str, latency: str, version: str | None = None) -> DataFrame:
    """Mean, median, deviation, range of scores as reports state them, and interpolated latency percentiles."""
    extra = [F.countDistinct(version).alias("versions")] if version else []
    base = df.agg(
        F.count("*").alias("n"),
        F.avg(score).alias("mean_score"),
        F.stddev_pop(score).alias("std_score"),
        F.least(F.lit(1.0), F.min(score)).alias("min_score"),
        F.greatest(F.lit(0.0), F.max(score)).alias("max_score"),
        *extra,
    )
    one = lambda d: d.withColumn("k_", F.lit(1))
    median = quantiles(df, score, {"median_score": 0.5}, interpolate=True)
    slow = quantiles(df, latency, {"p50_latency": 0.5, "p95_latency": 0.95, "p99_latency": 0.99}, interpolate=True)
    return one(base).join(one(median), "k_", "left").join(one(slow), "k_", "left").drop("k_")


def population_stability(df: DataFrame, column: str, order: list[str], bins: int = 10, eps: float = 1e-6, least: int = 20) -> DataFrame:
    """PSI of the later half against the first half in the given order, as one row (psi).

    The first n // 2 rows are found by counting over a range-partitioned sort; shares of equal-width bins over the
    joint range get ``eps`` added. Under ``least`` rows, and where all values are equal, it is 0.
    """
    rows = df.select(F.col(column).cast("double").alias("v"), F.struct(*order).alias("k"))
    total = rows.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    halves = with_rank(rows, "k").join(F.broadcast(total))  # one row is broadcast
    width = (F.col("hi") - F.col("lo")) / bins
    placed = halves.withColumn("bin", F.when(F.col("hi") <= F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width).cast("int"), F.lit(bins - 1))))
    counts = placed.groupBy("bin").agg(F.count_if(F.col("rank") <= F.floor(F.col("n") / 2)).alias("a"), F.count_if(F.col("rank") > F.floor(F.col("n") / 2)).alias("b"), F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    full = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left")
    half = F.max("n").over(Window.partitionBy())
    shares = full.withColumn("first", F.floor(half / 2)).withColumn("p", F.coalesce("a", F.lit(0)) / F.col("first") + eps).withColumn("q", F.coalesce("b", F.lit(0)) / (half - F.col("first")) + eps)
    terms = shares.agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"), F.max("n").alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    return terms.select(F.when((F.coalesce("n", F.lit(0)) < least) | (F.col("hi") <= F.col("lo")), 0.0).otherwise(F.col("psi")).alias("psi"))


def with_rank(rows: DataFrame, key: str) -> DataFrame:
    """Adds rank, 1 upward in the order of ``key``, without putting all rows in one task.

    Rows are sorted by range; each partition numbers its own, and the numbers of rows before it are added. The sorted
    rows are written once to the shared folder: both uses must see the same partitions, also when executors are lost.
    """
    path = scratch(rows.sparkSession, "ranked")
    rows.repartitionByRange(key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().alias("at_")).write.parquet(path)
    local = rows.sparkSession.read.parquet(path).withColumn("own_", F.col("at_") - F.shiftleft(F.col("part_").cast("long"), 33) + 1)
    sizes = local.groupBy("part_").agg(F.max("own_").alias("size_"))
    before = sizes.select("part_", (F.sum("size_").over(Window.orderBy("part_")) - F.col("size_")).alias("before_"))
    return local.join(F.broadcast(before), "part_").withColumn("rank", F.col("own_") + F.col("before_")).drop("part_", "at_", "own_", "before_")  # a row a partition is broadcast


def counts_by_type(df: DataFrame, column: str, types: int = 8) -> DataFrame:
    """Counts of types 0 .. types - 1; others are custom and left out."""
    return df.filter(F.col(column).between(0, types - 1)).groupBy(column).agg(F.count("*").alias("n"))


def transitions(df: DataFrame, column: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows where the value differs from that of the row before, the first row included; so repeats are possible."""
    seen = Window.partitionBy(*(by or [])).orderBy(*order)
    changed = df.withColumn("before_", F.lag(column).over(seen)).withColumn("first_", F.row_number().over(seen) == 1)
    return changed.filter(F.col("first_") | ~F.col(column).eqNullSafe(F.col("before_"))).drop("first_", "before_")


def transition_list(df: DataFrame, column: str, order: list[str], by: list[str]) -> DataFrame:
    """Per group the changes in order, joined by commas."""
    kept = transitions(df, column, order, by)
    return kept.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("v_")))), lambda x: x["v_"]), ",").alias("transitions"))


def first_of(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first value of each column, in order, that is neither null nor empty."""
    return df.agg(*[F.min_by(F.nullif(c, F.lit("")), F.when(F.nullif(c, F.lit("")).isNotNull(), F.struct(*order))).alias(c) for c in columns])


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
