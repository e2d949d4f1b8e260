"""Scaling features by statistics of the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.plans.attach import attach, per_series
from gridtide.plans.timeline import DAILY, SeriesOrder

KINDS = ("standard", "minmax")


def _statistics(kind: str, columns: Sequence[str], split: str) -> dict[str, Column]:
    """Per column the two training statistics a scaler needs; as SQL text, since tables are wide."""
    if kind not in KINDS:
        raise ValueError(f"unknown scaler {kind!r}; use one of {KINDS}")
    first, second = ("avg", "stddev_pop") if kind == "standard" else ("min", "max")
    return {f"{c}__{n}": F.expr(f"{f}(CASE WHEN `{split}` = 'train' THEN `{c}` END)")
            for c in columns for n, f in (("offset", first), ("width", second))}


def _widths(df: DataFrame, kind: str, columns: Sequence[str]) -> DataFrame:
    """Second statistic to a positive width; a constant column, up to rounding noise, has width 1."""
    out = {}
    for c in columns:
        width = f"`{c}__width`" if kind == "standard" else f"(`{c}__width` - `{c}__offset`)"
        out[f"{c}__width"] = F.expr(f"CASE WHEN {width} > 1e-14D * abs(`{c}__offset`) THEN {width} ELSE 1D END")
    return df.withColumns(out)


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard", *, split: str = "split",
               by: Sequence[str] = ("series_id",)) -> DataFrame:
    """The scaler as a table: offsets and widths of the training rows, one row per group."""
    stats = _statistics(kind, columns, split)
    fitted = df.groupBy(*by).agg(*(c.alias(n) for n, c in stats.items()))
    return _widths(fitted, kind, columns)


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str], *, by: Sequence[str] = ("series_id",)) -> DataFrame:
    return _scaled(attach(df, scaler, by), columns)


def _scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    scaled = {c: F.expr(f"(`{c}` - `{c}__offset`) / `{c}__width`") for c in columns}
    return df.withColumns(scaled).drop(*(f"{c}__{s}" for c in columns for s in ("offset", "width")))


def _scale(df: DataFrame, columns: Sequence[str], kind: str, split: str, per: bool, order: SeriesOrder) -> DataFrame:
    if not per:
        return apply_scaler(df, fit_scaler(df, columns, kind, split=split, by=()), columns, by=())
    marked = per_series(df, _statistics(kind, columns, split), order)
    return _scaled(_widths(marked, kind, columns), columns)


def standard_scale(df: DataFrame, columns: Sequence[str], *, split: str = "split", per: bool = True,
                   order: SeriesOrder = DAILY) -> DataFrame:
    """Zero mean and unit population deviation over the training rows, per series or over all of them."""
    return _scale(df, columns, "standard", split, per, order)


def minmax_scale(df: DataFrame, columns: Sequence[str], *, split: str = "split", per: bool = True,
                 order: SeriesOrder = DAILY) -> DataFrame:
    """0 to 1 over the training rows, per series or over all of them."""
    return _scale(df, columns, "minmax", split, per, order)
