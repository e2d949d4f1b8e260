"""Sequences of consecutive feature rows for sequence models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from gridtide.plans.timeline import DAILY, SeriesOrder, split_order, windowed


def _sequences(df: DataFrame, columns: Sequence[str], length: int, first: int, last: int, split: str | None,
               order: SeriesOrder) -> DataFrame:
    """Sequences stay inside a split: each split of a series is windowed on its own."""
    if length < 1:
        raise ValueError(f"a sequence needs at least one row, got {length}")
    within = split_order(order, split) if split else order
    step = F.array(*(F.col(c).cast("double") for c in columns))

    def collected(w: WindowSpec):
        return {"seq": F.collect_list(step).over(w.rowsBetween(first, last))}

    rows = windowed(df, collected, order=within, lookback=-first)
    return rows.filter(F.size("seq") == length)


def sequences_next(df: DataFrame, columns: Sequence[str], length: int = 14, *, split: str | None = "split",
                   order: SeriesOrder = DAILY) -> DataFrame:
    """`seq`: the `length` rows before the labelled row."""
    return _sequences(df, columns, length, -length, -1, split, order)


def sequences_same(df: DataFrame, columns: Sequence[str], length: int = 14, *, split: str | None = "split",
                   order: SeriesOrder = DAILY) -> DataFrame:
    """`seq`: the labelled row and the `length - 1` rows before it."""
    return _sequences(df, columns, length, 1 - length, 0, split, order)


def sequence_last_step(df: DataFrame, *, seq: str = "seq", name: str = "features") -> DataFrame:
    """Back to one feature row: the last step of each sequence."""
    return df.withColumn(name, F.element_at(seq, -1))


def flatten_sequence(df: DataFrame, *, seq: str = "seq", name: str = "features") -> DataFrame:
    """All steps of a sequence in one array, oldest first."""
    return df.withColumn(name, F.flatten(seq))
