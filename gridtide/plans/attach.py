"""Joins on series keys, and statistics of a series joined back to its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.plans.keys import key_of
from gridtide.plans.timeline import DAILY, SeriesOrder


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on `keys` in which NULL equals NULL; the keys are taken from the left."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    named = right.withColumn("_on", key_of(keys)).drop(*keys)
    return left.withColumn("_on", key_of(keys)).join(named, "_on", how).drop("_on")


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join `stats`, one short row per key, to many rows per key.

    Spark broadcasts `stats` where it finds it to be small. Where it has to shuffle, a hot key makes a
    skewed partition on the side of the rows, which adaptive execution splits; `stats` has one row for it.
    """
    return join_on(rows, stats, keys, how)


def per_series(df: DataFrame, aggregates: Mapping[str, Column], order: SeriesOrder = DAILY) -> DataFrame:
    """Add aggregates over each series to its rows.

    A series that is windowed whole needs no further shuffle; one cut into blocks is aggregated with
    partial sums first and the result joined back.
    """
    if not order.blocked(df):
        w = Window.partitionBy(*order.keys)
        return df.withColumns({n: c.over(w) for n, c in aggregates.items()})
    stats = df.groupBy(*order.keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return attach(df, stats, order.keys)
