"""Sliding event rates and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_rate(df: DataFrame, ts: str, width: int, tie: str, by: list[str] | None = None, alert_at: int = 10) -> DataFrame:
    """Adds event_count: events from ts - width to this one, in order of (ts, tie), and alert.

    A range frame also counts later events of the same time; they are taken off again. Without ``by`` the whole
    stream would be one partition: see ``sliding_rate_bucketed``.
    """
    by = by or []
    frame = Window.partitionBy(*by).orderBy(F.col(ts)).rangeBetween(-width, 0)
    peers = Window.partitionBy(*by, ts)
    count = F.count("*").over(frame) - F.count("*").over(peers) + F.row_number().over(peers.orderBy(tie))
    return df.withColumn("event_count", count).withColumn("alert", F.col("event_count") >= alert_at)


def sliding_rate_bucketed(df: DataFrame, ts: str, width: int, tie: str, by: list[str] | None = None, alert_at: int = 10) -> DataFrame:
    """The same over one stream of any length, or a key with any number of events: they are dealt out by (key and) spans of ``width``.

    A window touches its own span and the one before, so each event goes to its own span and, as a mere
    neighbour, to the next.
    """
    by = by or []
    span = F.floor(F.col(ts) / F.lit(width)).cast("long")
    own = df.withColumn("span_", span).withColumn("own_", F.lit(True))
    lent = df.withColumn("span_", span + 1).withColumn("own_", F.lit(False))
    counted = sliding_rate(own.unionByName(lent), ts, width, tie, [*by, "span_"], alert_at)
    return counted.filter("own_").drop("span_", "own_")


def count_at(df: DataFrame, ts: str, now: int, width: int) -> DataFrame:
    return df.filter(F.col(ts).between(now - width, now)).agg(F.count("*").alias("event_count"))


def gaps(df: DataFrame, ts: str, longest: int, by: list[str] | None = None) -> DataFrame:
    """(by, gap_start, gap_end) wherever the next row of a group comes later than ``longest``."""
    seen = Window.partitionBy(*(by or [])).orderBy(ts)
    spaced = df.select(*(by or []), F.lag(ts).over(seen).alias("gap_start"), F.col(ts).alias("gap_end"))
    return spaced.filter(F.col("gap_end") - F.col("gap_start") > longest)
