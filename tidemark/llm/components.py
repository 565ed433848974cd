"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any ordered type to (node, root): root is the smallest node of the component.

    Nodes without an edge do not occur. Each step is a grouped minimum and an equi-join, written to the
    shared folder; the edge table never grows and nothing of it comes to the driver but its checksum. The minima of the
    large star are written before they are joined, so that the edges of a hub, which share its key, meet them in a join of two plain shuffles,
    which Spark splits where it is skewed. Tables of earlier steps are deleted. An empty table gives an empty one;
    loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    now = written(spark, edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        # large star: larger neighbours of a node go to the smallest of it and its neighbours; only nodes with a smaller neighbour change anything
        low = written(spark, now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m"), "lowest")
        large = written(spark, now.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "edges")
        forget(now, low)
        # small star: smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        now = written(spark, small, "edges")
        forget(large)
        before, state = state, _state(now)
        if state == before:
            break
    # now a forest of depth one: every node but the roots points at its root
    forest = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = written(spark, forest, "components")
    forget(now)
    return out
