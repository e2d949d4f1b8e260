"""Returns of positions, trading metrics and equity curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.windows import lead
from gridtide.plans.timeline import DAILY, SeriesFrame, SeriesOrder, windowed

TRADING_DAYS = 252


def position_from_prediction(pred: Column, rule: str = "sign") -> Column:
    """`sign`: +1 above zero, else -1. `threshold`: +1 above zero, else 0."""
    sides = {"sign": -1, "threshold": 0}
    if rule not in sides:
        raise ValueError(f"unknown trading rule {rule!r}; use one of {sorted(sides)}")
    return F.when(pred > 0, 1).otherwise(sides[rule])


def summarise_returns(r: Column) -> list[Column]:
    """Aggregates of a column of strategy returns; zeros when there are none."""
    mean, spread = F.avg(r), F.stddev_pop(r)

    def or_zero(c):
        return F.coalesce(c, F.lit(0.0))

    return [
        F.count(r).alias("total_trades"),
        or_zero(F.avg(F.when(r.isNotNull(), (r > 0).cast("double")))).alias("win_rate"),
        or_zero(F.sum(r)).alias("roi"),
        or_zero(F.when(spread > 0, mean / spread * F.sqrt(F.lit(float(TRADING_DAYS))))).alias("sharpe"),
        or_zero(mean).alias("avg_return"),
    ]


def trading_metrics(df: DataFrame, actual: str = "actual", pred: str = "pred", rule: str = "sign",
                    by: Sequence[str] = ()) -> DataFrame:
    """Trading metrics of predictions; pairs with a missing side do not count."""
    known = df.filter(F.col(actual).isNotNull() & F.col(pred).isNotNull())
    r = position_from_prediction(F.col(pred), rule) * F.col(actual)
    return known.groupBy(*by).agg(*summarise_returns(r))


def trading_metrics_from_frame(df: DataFrame, algo_return: str = "algo_return", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*summarise_returns(F.col(algo_return)))


def algo_return_summary(df: DataFrame, algo_return: str = "algo_return", by: Sequence[str] = ()) -> DataFrame:
    r = F.col(algo_return)
    return df.groupBy(*by).agg(F.avg(r).alias("algo_returns_mean"), F.stddev_pop(r).alias("algo_returns_std"))


def strategy_returns(df: DataFrame, *, price: str = "price", position: str = "position", next_price: str = "next_price",
                     order: SeriesOrder = DAILY) -> DataFrame:
    """Add the return to the next row (0 on the last) and that return times the position.

    Rows that bring their next price along, in the column `next_price`, are not windowed again.
    """
    moved = df if next_price in df.columns else windowed(df, lambda w: {next_price: lead(price, w)}, order=order, lookahead=1)
    actual = F.coalesce((F.col(next_price) - F.col(price)) / F.col(price), F.lit(0.0))
    return moved.withColumn("actual_return", actual).withColumn(
        "strategy_return", F.col(position) * F.col("actual_return")).drop(next_price)


def compounded_roi(df: DataFrame, returns: str = "strategy_return", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(((F.product(1 + F.col(returns)) - 1) * 100).alias("roi_pct"))


def equity_curve(df: DataFrame, curves: dict[str, str], *, scale: float = 1.0, order: SeriesOrder = DAILY) -> DataFrame:
    """Per curve name: the compounded growth so far of a return column."""
    frame = SeriesFrame.open(df, order).running_product({n: 1 + F.col(c) for n, c in curves.items()})
    return frame.close().withColumns({n: (F.col(n) - 1) * scale for n in curves})


def trading_frame(df: DataFrame, actual: str = "actual", pred: str = "pred", *, order: SeriesOrder = DAILY) -> DataFrame:
    """Position, strategy return, and both cumulative returns for each row."""
    rows = df.withColumn("position", position_from_prediction(F.col(pred))).withColumn(
        "algo_return", F.col("position") * F.col(actual))
    return equity_curve(rows, {"cumulative_return": "algo_return", "cumulative_actual": actual}, order=order)


def cumulative_return_curve(df: DataFrame, *, actual: str = "actual_return", strategy: str = "strategy_return",
                            order: SeriesOrder = DAILY) -> DataFrame:
    """Market and strategy growth in percent."""
    return equity_curve(df, {"market_pct": actual, "strategy_pct": strategy}, scale=100.0, order=order)


def balance_roi(df: DataFrame, capital: float = 10_000.0, *, balance: str = "balance",
                order: SeriesOrder = DAILY) -> DataFrame:
    """Growth of the last balance of every series over the starting capital, in percent."""
    last = F.max_by(balance, order.place())
    return df.groupBy(*order.keys).agg(((last - capital) / capital * 100).alias("balance_roi"))
