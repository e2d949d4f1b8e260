"""Filters, flags and replacements that prepare a raw market table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions.scalars import nan_to_null
from gridtide.functions.windows import difference
from gridtide.plans.attach import per_series
from gridtide.plans.timeline import DAILY, SeriesFrame, SeriesOrder, windowed
from gridtide.sources.market import CORE

NO_CHANGE = 1e-6


def real_price(price: str = "price") -> Column:
    """True where a price was observed: present and above zero."""
    return F.coalesce(F.col(price) > 0, F.lit(False))


def real_price_flag(df: DataFrame, *, price: str = "price", name: str = "has_real_price") -> DataFrame:
    return df.withColumn(name, real_price(price))


def filter_real_price(df: DataFrame, *, name: str = "has_real_price") -> DataFrame:
    return df.filter(F.col(name))


def drop_missing_critical(df: DataFrame, columns: Sequence[str] = CORE) -> DataFrame:
    """Rows with a value in each of the columns that exist."""
    return df.na.drop("any", subset=[c for c in columns if c in df.columns])


def filter_positive_price(df: DataFrame, *, price: str = "price") -> DataFrame:
    return df.filter(F.col(price) > 0)


def drop_zero_change(df: DataFrame, *, price: str = "price", order: SeriesOrder = DAILY) -> DataFrame:
    """Drop rows whose price equals the one before.

    A series that has such rows also loses its first row; a series without any stays as it is.
    """
    moved = order.cut(windowed(df, lambda w: {"_change": F.abs(difference(price, w))}, order=order, lookback=1))
    flat = F.coalesce(F.col("_change") < NO_CHANGE, F.lit(False))
    marked = per_series(moved, {"_has_flat": F.max(flat.cast("int"))}, order)
    return marked.filter((F.col("_has_flat") == 0) | (F.col("_change") >= NO_CHANGE)).drop("_change", "_has_flat")


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any missing value.

    One count of the missing values, not one condition per column: tables are wide here, and the
    optimizer would carry every single condition through the whole plan.
    """
    missing = " + ".join(f"CAST(`{c}` IS NULL AS INT)" for c in columns or df.columns)
    return df.filter(f"{missing} = 0")


def inf_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Infinite and NaN values to NULL in floating-point columns."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = [c for c in floats if columns is None or c in columns]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in chosen})


def replace_zero_price(df: DataFrame, *, price: str = "price", known: Column | None = None, per: bool = True,
                       order: SeriesOrder = DAILY) -> DataFrame:
    """Zero prices become the mean of the positive ones (of the rows where `known` holds).

    The mean is that of the series, or of the whole table with `per=False`.
    """
    usable = F.col(price) > 0 if known is None else (F.col(price) > 0) & known
    mean = F.avg(F.when(usable, F.col(price)))
    if per:
        marked = per_series(df, {"_mean": mean}, order)
    else:
        marked = df.crossJoin(F.broadcast(df.agg(mean.alias("_mean"))))  # one row
    filled = F.when(F.col(price) == 0, F.coalesce("_mean", F.col(price))).otherwise(F.col(price))
    return marked.withColumn(price, filled).drop("_mean")


def replace_zero_price_train_only(df: DataFrame, *, price: str = "price", split: str = "split", per: bool = True,
                                  order: SeriesOrder = DAILY) -> DataFrame:
    return replace_zero_price(df, price=price, known=F.col(split) == "train", per=per, order=order)


def date_range_filter(df: DataFrame, start: str | None = None, end: str | None = None, *,
                      ts: str = "trade_date") -> DataFrame:
    """Rows between two dates, both included."""
    kind = df.schema[ts].dataType
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast(kind))
    return df


def forward_fill(df: DataFrame, columns: Sequence[str], order: SeriesOrder = DAILY) -> DataFrame:
    """Missing values take the latest earlier one of their series."""
    return SeriesFrame.open(df, order).running_last({c: F.col(c) for c in columns}).close()


def backward_fill(df: DataFrame, columns: Sequence[str], order: SeriesOrder = DAILY) -> DataFrame:
    """Missing values take the next later one. This looks ahead in time."""
    return SeriesFrame.open(df, order).running_next({c: F.col(c) for c in columns}).close()


def count_violations(df: DataFrame, columns: Sequence[str], order: SeriesOrder = DAILY) -> DataFrame:
    """One row: rows, missing and non-finite values per column, missing dates, repeated (series, time)."""
    per_row = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        finite = F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(True))
        per_row.append(F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}"))
        per_row.append(F.sum((~finite).cast("long")).alias(f"nonfinite_{c}"))
    places = df.groupBy(*order.columns()).agg(*per_row)
    totals = [F.sum("n").alias("rows"),
              F.sum(F.when(F.col(order.ts).isNull(), F.col("n")).otherwise(0)).alias("null_time"),
              F.sum(F.when(F.col(order.ts).isNotNull(), F.col("n") - 1).otherwise(0)).alias("repeated_time")]
    totals += [F.sum(f"{kind}_{c}").alias(f"{kind}_{c}") for c in columns for kind in ("null", "nonfinite")]
    return places.agg(*totals)


class BadData(ValueError):
    """Data breaks a rule it was checked against."""


def assert_quality(df: DataFrame, columns: Sequence[str], order: SeriesOrder = DAILY) -> DataFrame:
    """`df` unchanged, or BadData naming the broken rules."""
    found = count_violations(df, columns, order).first().asDict()
    if not found["rows"]:
        raise BadData("no rows")
    broken = {rule: n for rule, n in found.items() if rule != "rows" and n}
    if broken:
        raise BadData(", ".join(f"{rule}={n}" for rule, n in broken.items()))
    return df


def clean_market(df: DataFrame, *, drop_flat: bool = False, price: str = "price", order: SeriesOrder = DAILY) -> DataFrame:
    """Complete rows with a positive price, optionally without unchanged prices."""
    rows = filter_positive_price(drop_missing_critical(df), price=price)
    return drop_zero_change(rows, price=price, order=order) if drop_flat else rows


def cleaning_counts(df: DataFrame, columns: Sequence[str] = CORE, *, price: str = "price",
                    by: Sequence[str] = ()) -> DataFrame:
    """How many rows each cleaning step removes, counted in one pass."""
    missing = F.lit(False)
    for c in columns:
        if c in df.columns:
            missing = missing | F.col(c).isNull()
    bad = ~missing & F.coalesce(F.col(price) <= 0, F.lit(False))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(missing.cast("long")).alias("missing_rows"),
        F.sum(bad.cast("long")).alias("bad_price_rows"),
        F.sum((~missing & ~bad).cast("long")).alias("clean_rows"),
    )
