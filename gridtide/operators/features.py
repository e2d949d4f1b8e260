"""Windowed features of market series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gridtide.functions import windows as X
from gridtide.operators.cleaning import drop_any_null, inf_to_null
from gridtide.plans.timeline import DAILY, SeriesFrame, SeriesOrder, windowed
from gridtide.sources.market import CORE, numeric_projection, require_columns


def lag_features(df: DataFrame, columns: Sequence[str] = CORE, lags: Sequence[int] = (1,), *,
                 order: SeriesOrder = DAILY) -> DataFrame:
    return windowed(df, lambda w: {f"{c}_lag{k}": X.lag(c, w, k) for c in columns for k in lags},
                    order=order, lookback=max(lags))


def price_diff(df: DataFrame, column: str = "price", *, name: str = "price_change", order: SeriesOrder = DAILY) -> DataFrame:
    return windowed(df, lambda w: {name: X.difference(column, w)}, order=order, lookback=1)


def pct_change(df: DataFrame, columns: Sequence[str] = CORE, *, suffix: str = "_return", order: SeriesOrder = DAILY) -> DataFrame:
    """One-row relative change; NULL after a zero and next to a gap."""
    return windowed(df, lambda w: {f"{c}{suffix}": X.relative_change(c, w) for c in columns}, order=order, lookback=1)


def momentum(df: DataFrame, column: str = "price", spans: Sequence[int] = (3, 7), *, order: SeriesOrder = DAILY) -> DataFrame:
    return windowed(df, lambda w: {f"momentum_{k}d": X.relative_change(column, w, k) for k in spans},
                    order=order, lookback=max(spans))


def rolling_mean(df: DataFrame, columns: Sequence[str], n: int = 7, *, order: SeriesOrder = DAILY) -> DataFrame:
    return windowed(df, lambda w: {f"{c}_rolling_mean_{n}d": X.rolling_mean(c, w, n) for c in columns},
                    order=order, lookback=n - 1)


def rolling_std(df: DataFrame, columns: Sequence[str], n: int = 7, *, order: SeriesOrder = DAILY) -> DataFrame:
    return windowed(df, lambda w: {f"{c}_rolling_std_{n}d": X.rolling_std(c, w, n) for c in columns},
                    order=order, lookback=n - 1)


def volatility(df: DataFrame, column: str = "price", spans: Sequence[int] = (7, 30), *, order: SeriesOrder = DAILY) -> DataFrame:
    """Rolling deviation of the one-row relative change."""
    return windowed(df, lambda w: {"_return": X.relative_change(column, w)},
                    lambda w: {f"volatility_{n}d": X.rolling_std("_return", w, n) for n in spans},
                    order=order, lookback=max(spans)).drop("_return")


def price_position(df: DataFrame, column: str = "price", n: int = 14, *, order: SeriesOrder = DAILY) -> DataFrame:
    return windowed(df, lambda w: {"price_position": X.range_position(column, w, n)}, order=order, lookback=n - 1)


def trend_slope(df: DataFrame, column: str = "price", n: int = 14, *, order: SeriesOrder = DAILY) -> DataFrame:
    frame = SeriesFrame.open(df, order, lookback=n - 1).index("_place")
    return frame.with_columns(lambda w: {"trend_slope": X.rolling_slope(column, w, n, "_place")}).close().drop("_place")


def calendar_v1(ts: str = "trade_date") -> dict[str, Column]:
    day = F.weekday(ts)
    return {"Day": F.dayofmonth(ts), "Month": F.month(ts), "Year": F.year(ts), "Weekday": day,
            "IS_WORKDAY": (day < 5).cast("int")}


def calendar_v2(ts: str = "trade_date") -> dict[str, Column]:
    return {"day": F.dayofmonth(ts), "month": F.month(ts), "year": F.year(ts), "weekday": F.weekday(ts),
            "quarter": F.quarter(ts), "day_of_year": F.dayofyear(ts)}


def calendar_features(df: DataFrame, *, ts: str = "trade_date") -> DataFrame:
    """Calendar parts of the date; weekdays count from Monday = 0."""
    v1 = calendar_v1(ts)
    return df.withColumns({**calendar_v2(ts), "is_workday": v1["IS_WORKDAY"]})


def feature_frame_v1(df: DataFrame, *, order: SeriesOrder = DAILY) -> DataFrame:
    """Core columns, calendar, and 17 windowed features; rows with any missing value are dropped."""
    require_columns(df, [*order.columns(), *CORE])
    flag = F.col("has_real_price") if "has_real_price" in df.columns else F.lit(True)
    rows = inf_to_null(df.select(*order.columns(), *CORE, flag.alias("has_real_price")))

    def first(w: WindowSpec) -> dict[str, Column]:
        out = {"price_return": X.relative_change("price", w)}
        out.update({f"{c}_pct_change": X.relative_change(c, w) for c in CORE[1:]})
        out.update({f"{c}_lag1": X.lag(c, w) for c in ("price", "volume", "gas_price")})
        out.update({
            "price_rolling_mean_7d": X.rolling_mean("price", w, 7),
            "price_rolling_std_7d": X.rolling_std("price", w, 7),
            "volume_rolling_mean_7d": X.rolling_mean("volume", w, 7),
            "momentum_3d": X.relative_change("price", w, 3),
            "momentum_7d": X.relative_change("price", w, 7),
            "price_position": X.range_position("price", w, 14),
            "trend_slope": X.rolling_slope("price", w, 14, "_place"),
        })
        return out

    frame = SeriesFrame.open(rows, order, lookback=30).index("_place").with_columns(first)
    frame = frame.with_columns(lambda w: {f"volatility_{n}d": X.rolling_std("price_return", w, n) for n in (7, 30)})
    return drop_any_null(frame.close().drop("_place")).withColumns(calendar_v1(order.ts))


def features_v2_names(columns: Sequence[str]) -> list[str]:
    return [f"{c}_{s}" for c in columns for s in ("return", "lag1", "lag2", "lag3", "roll7_mean", "roll7_std")]


def feature_frame_v2(df: DataFrame, columns: Sequence[str] = CORE, *, order: SeriesOrder = DAILY) -> DataFrame:
    """Per core column that exists: change, three lags, rolling mean and deviation; plus the calendar.

    Only numeric columns and those of the order go on, so a gap in a text or a delivery date drops no row.
    """
    df = numeric_projection(df, order.columns())
    present = [c for c in columns if c in df.columns]

    def derived(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in present:
            out[f"{c}_return"] = X.relative_change(c, w)
            out.update({f"{c}_lag{k}": X.lag(c, w, k) for k in (1, 2, 3)})
            out[f"{c}_roll7_mean"] = X.rolling_mean(c, w, 7)
            out[f"{c}_roll7_std"] = X.rolling_std(c, w, 7)
        return out

    rows = windowed(inf_to_null(df), derived, order=order, lookback=6)
    return drop_any_null(rows).withColumns(calendar_v2(order.ts))


def exog_returns(df: DataFrame, column: str = "price", *, name: str = "price_move", order: SeriesOrder = DAILY) -> DataFrame:
    """Relative change over the whole series, so that a split starts from the last value before it.

    The change after a zero counts the step itself; a missing change is 0.
    """
    def move(w: WindowSpec) -> dict[str, Column]:
        before = X.lag(column, w)
        base = F.when(before == 0, 1.0).otherwise(before)
        return {name: F.coalesce((F.col(column) - before) / base, F.lit(0.0))}

    return windowed(df, move, order=order, lookback=1)
