"""Pieces of column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` evaluated once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(n_items: Column, size: int) -> Column:
    """1-based starts of all windows of ``size`` items; empty if there are fewer items."""
    return F.when(n_items >= size, F.sequence(F.lit(1), n_items - size + 1)).otherwise(F.array().cast("array<int>"))


def long_array(values: list[int]) -> Column:
    """A constant array of longs: folded into one literal when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
