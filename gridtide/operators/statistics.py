"""Summaries of a market table and its targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.windows import difference
from gridtide.operators.cleaning import NO_CHANGE
from gridtide.plans.timeline import DAILY, SeriesOrder, windowed


def price_summary(df: DataFrame, *, price: str = "price", ts: str = "trade_date", by: Sequence[str] = ("series_id",)) -> DataFrame:
    spread = F.stddev_samp(price)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.datediff(F.max(ts), F.min(ts)).alias("days"),
        F.avg(price).alias("avg_price"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        spread.alias("std_price"),
        (F.try_divide(spread, F.avg(price)) * 100).alias("volatility_pct"),
    )


def class_distribution(df: DataFrame, *, label: str = "y_target", by: Sequence[str] = ()) -> DataFrame:
    """Rows and percentage of each class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(*by)))


def class_balance_ratio(df: DataFrame, *, label: str = "y_target", by: Sequence[str] = (), limit: float = 0.8) -> DataFrame:
    counts = class_distribution(df, label=label, by=by)
    ratio = F.min("n") / F.max("n")
    return counts.groupBy(*by).agg(ratio.alias("balance_ratio"), (ratio < limit).alias("imbalanced"))


def zero_change_share(df: DataFrame, *, price: str = "price", limit_pct: float = 10.0, order: SeriesOrder = DAILY) -> DataFrame:
    """How many price changes are zero; more than the limit hints at filled gaps."""
    moved = windowed(df.filter(F.col(price).isNotNull()), lambda w: {"_change": F.abs(difference(price, w))},
                     order=order, lookback=1)
    flat = (F.col("_change") < NO_CHANGE).cast("long")
    share = F.try_divide(F.sum(flat) * 100.0, F.count("_change"))
    return moved.groupBy(*order.keys).agg(
        F.count(F.lit(1)).alias("records"), F.count("_change").alias("changes"),
        F.coalesce(F.sum(flat), F.lit(0)).alias("zero_changes"), share.alias("zero_pct"),
        F.coalesce(share > limit_pct, F.lit(False)).alias("suspicious"))


def target_summary(df: DataFrame, *, target: str = "y_target", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(target).alias("mean"), F.stddev_pop(target).alias("std"),
                               F.min(target).alias("min"), F.max(target).alias("max"))


def _pearson(x: str, y: str) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, F.col(x))) * F.var_pop(F.when(both, F.col(y))))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))


def feature_target_corr(df: DataFrame, features: Sequence[str], *, target: str = "y_target", by: Sequence[str] = ()) -> DataFrame:
    """|Pearson| of every feature with the target in one pass; 0 for a constant feature."""
    wide = df.groupBy(*by).agg(*(F.abs(_pearson(c, target)).alias(c) for c in features))
    return wide.unpivot(list(by), list(features), "feature", "abs_corr")


def topk_features(df: DataFrame, features: Sequence[str], k: int = 50, *, target: str = "y_target") -> DataFrame:
    """The k features that correlate most with the target."""
    return feature_target_corr(df, features, target=target).orderBy(F.desc("abs_corr"), "feature").limit(k)


def class_weights(df: DataFrame, *, label: str = "y_target", by: Sequence[str] = (), low: float = 1.0, high: float = 10.0) -> DataFrame:
    """The weight of the positive class: negatives over positives, kept between two bounds."""
    pos, neg = (F.sum((F.col(label) == v).cast("long")) for v in (1, 0))
    weight = F.least(F.greatest(F.try_divide(neg, pos), F.lit(low)), F.lit(high))
    return df.groupBy(*by).agg(neg.alias("negatives"), pos.alias("positives"),
                               F.when(pos > 0, weight).otherwise(1.0).alias("pos_weight"))


def head_preview(df: DataFrame, n: int = 5, *, order: SeriesOrder = DAILY) -> DataFrame:
    return df.orderBy(F.col(order.ts).asc_nulls_last(), *order.keys, *order.tie).limit(n)


def sort_by_date(df: DataFrame, *, order: SeriesOrder = DAILY) -> DataFrame:
    return df.orderBy(F.col(order.ts).asc_nulls_last(), *order.keys, *order.tie)
