"""Point-in-time lookups over versioned entity rows.

Order of an entity's rows: time, then version, then the tie columns given (file and row place for a scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(spine: DataFrame, features: DataFrame, key: str, ts: str, payload: list[str], version: str | None = None, ties: list[str] | None = None, keep_unmatched: bool = True) -> DataFrame:
    """For each spine row the key's last feature row at or before its time.

    One shuffle by key: both sides are laid into one stream in time order, and the last feature seen is carried
    forward. Columns of the result: the spine's, ``feature_<ts>``, and the payload; nulls where nothing came before.
    """
    ordering = [c for c in [version, *(ties or [])] if c]
    carried = F.struct(F.col(ts).alias(f"feature_{ts}"), *[F.col(c) for c in payload])
    right = features.select(F.col(key), F.col(ts), F.lit(0).alias("side_"), carried.alias("row_"), *[F.col(c).alias(f"o{i}_") for i, c in enumerate(ordering)])
    others = [c for c in spine.columns if c not in (key, ts)]
    left = spine.select(F.col(key), F.col(ts), F.lit(1).alias("side_"), *([F.struct(*others).alias("spine_")] if others else []))
    both = left.unionByName(right, allowMissingColumns=True)
    forward = Window.partitionBy(key).orderBy(F.col(ts), F.col("side_"), *[F.col(f"o{i}_").asc_nulls_first() for i in range(len(ordering))]).rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("last_", F.last("row_", ignorenulls=True).over(forward)).filter("side_ = 1")
    if not keep_unmatched:
        matched = matched.filter(F.col("last_").isNotNull())
    return matched.select(key, ts, *[F.col(f"spine_.{c}").alias(c) for c in others], F.col(f"last_.feature_{ts}").alias(f"feature_{ts}"), *[F.col(f"last_.{c}").alias(c) for c in payload])


def as_of_join_by_spans(spine: DataFrame, features: DataFrame, key: str, ts: str, payload: list[str], version: str | None = None, ties: list[str] | None = None, spans: int = 64) -> DataFrame:
    """The same where one key may hold any share of all rows: rows are dealt out by key and span of time.

    Every span begins with the key's last feature row of the spans before it, found from one row a key and span. The
    time must be a number; ``spans`` cuts the range of the features' times.
    """
    low, high = features.agg(F.min(ts), F.max(ts)).first()
    low, high = (0, 0) if low is None else (low, high)
    span = F.least(F.greatest(F.floor((F.col(ts) - F.lit(low)) * spans / F.lit(high - low + 1)), F.lit(0)), F.lit(spans - 1)).cast("int")
    spread = lambda df: df.withColumn("span_", span)
    order = F.struct(ts, *[c for c in [version, *(ties or [])] if c])
    last = spread(features).groupBy(key, "span_").agg(F.max_by(F.struct(*features.columns), order).alias("row_"))
    seen = Window.partitionBy(key).orderBy("span_")
    # the last row of a span opens all spans up to the next one that has features
    reach = last.withColumn("until_", F.coalesce(F.lead("span_").over(seen), F.lit(spans - 1)))
    carried = reach.filter(F.col("span_") < spans - 1).select(key, "row_", F.explode(F.sequence(F.col("span_") + 1, "until_")).alias("span_"))
    opening = carried.select("span_", *[F.col(f"row_.{c}").alias(c) for c in features.columns])
    both = spread(features).unionByName(opening).withColumn("pair_", F.struct(F.col(key).alias("k"), F.col("span_").alias("s"))).drop(key, "span_")
    asked = spread(spine).withColumn("pair_", F.struct(F.col(key).alias("k"), F.col("span_").alias("s"))).drop(key, "span_")
    out = as_of_join(asked, both, "pair_", ts, payload, version, ties)
    return out.select(F.col("pair_.k").alias(key), *[c for c in out.columns if c != "pair_"])


def as_of(features: DataFrame, key: str, ts: str, at, version: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """Every entity's row at a moment; partial maxima come before the shuffle. Entities with no row by then are left out."""
    order = F.struct(ts, *[c for c in [version, *(ties or [])] if c])
    seen = features if at is None else features.filter(F.col(ts) <= F.lit(at))
    others = [c for c in features.columns if c != key]
    return seen.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def latest(features: DataFrame, key: str, ts: str, version: str | None = None, ties: list[str] | None = None) -> DataFrame:
    return as_of(features, key, ts, None, version, ties)


def as_of_batch(features: DataFrame, ids: DataFrame, key: str, ts: str, at, position: str = "position", version: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """Rows of the asked entities at one moment, repeats kept, misses left out; ``position`` holds the order asked for."""
    wanted = features.join(ids.select(key).distinct(), key, "left_semi")
    return ids.join(as_of(wanted, key, ts, at, version, ties), key)


def history(features: DataFrame, key: str, entity, ts: str, start, end, order: list[str] | None = None) -> DataFrame:
    """All rows of an entity from start to end, both included, oldest first."""
    return features.filter((F.col(key) == F.lit(entity)) & F.col(ts).between(F.lit(start), F.lit(end))).orderBy(ts, *(order or []))
