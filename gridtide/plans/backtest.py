"""A whole back-test as one plan: date range, strategy, returns, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.operators.cleaning import date_range_filter
from gridtide.operators.trading import strategy_returns, trading_metrics_from_frame
from gridtide.plans.timeline import DAILY, SeriesOrder


def backtest_report(df: DataFrame, strategy: Callable[..., DataFrame], *, start: str | None = None,
                    end: str | None = None, price: str = "price", order: SeriesOrder = DAILY, **params) -> DataFrame:
    """One row of trading metrics per series. Rows without a positive price are no trading days."""
    rows = date_range_filter(df, start, end, ts=order.ts).filter(F.col(price) > 0)
    rows = rows.select(*order.columns(), price)
    order = order.resolved(rows)
    signals = strategy(rows, price=price, next_price="next_price", order=order, **params)
    returns = strategy_returns(signals, price=price, order=order)
    return trading_metrics_from_frame(returns, "strategy_return", by=order.keys)
