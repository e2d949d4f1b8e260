"""Market tables: the CSV form, its dates and columns, and a daily table made from line items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.functions.scalars import nan_to_null

# Column headings of the raw daily file and the short names used here.
DATE_COLUMNS = {
    "Trade Date": "trade_date",
    "Electricity: Delivery Start Date": "delivery_start",
    "Electricity: Delivery End Date": "delivery_end",
}
CORE_COLUMNS = {
    "Electricity: Wtd Avg Price $/MWh": "price",
    "Electricity: Daily Volume MWh": "volume",
    "Natural Gas: Henry Hub Natural Gas Spot Price (Dollars per Million Btu)": "gas_price",
    "pjm_load sum in MW (daily)": "pjm_load",
    "temperature mean in C (daily): US": "temperature",
}
CORE = tuple(CORE_COLUMNS.values())

DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d")


class MissingColumns(ValueError):
    """The input lacks columns an operator needs."""


def scan_market_csv(spark: SparkSession, *paths: str, keep: Sequence[str] = (), series: str = "all") -> DataFrame:
    """Rows of CSV files, whose columns are found by the names in their heading line, in any order.

    Returns `series_id` (the constant `series` where the files have none), the date columns as text, the
    core columns as numbers, and the columns named in `keep` as text; the rest isn't parsed. Files below
    one path have one heading, other paths may have others. NaN, infinite and unreadable numbers are NULL.
    A core column that is in no file is absent here too, so that `require_columns` names it.
    """
    tables = []
    for path in paths:
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
        named = [F.col("series_id") if "series_id" in raw.columns else F.lit(series).alias("series_id")]
        named += [F.col(f"`{c}`") for c in (*DATE_COLUMNS, *keep) if c in raw.columns]
        named += [nan_to_null(F.col(f"`{c}`").try_cast("double")).alias(c) for c in CORE_COLUMNS if c in raw.columns]
        tables.append(raw.select(*named))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def parse_dates(df: DataFrame, columns: Sequence[str] = tuple(DATE_COLUMNS), formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Text to DATE in the columns that exist, by the first format that fits; text that is no date becomes NULL."""
    def parsed(c: Column) -> Column:
        found = [F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats]
        return F.coalesce(*found, c.try_cast("date"))

    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: parsed(F.col(f"`{c}`")) for c in present})


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns("missing columns: " + ", ".join(missing))
    return df


def core_projection(df: DataFrame, keep: Sequence[str] = ("series_id",),
                    names: Mapping[str, str] = CORE_COLUMNS, dates: Mapping[str, str] = DATE_COLUMNS) -> DataFrame:
    """Series key, trade date and the five core columns under their short names."""
    require_columns(df, [*keep, *names])
    dated = {raw: short for raw, short in dates.items() if raw in df.columns}
    return df.select(*keep, *(F.col(f"`{r}`").alias(s) for r, s in {**dated, **names}.items()))


def numeric_projection(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keep]
    return df.select(*keep, *numeric)


def hundredths(c: Column) -> Column:
    """Sum of amounts with two decimals as a whole number of hundredths, the same in any order."""
    return F.sum(F.rint(c * 100).cast("long"))


def market_daily(lineitem: DataFrame) -> DataFrame:
    """One row per series (return flag) and ship date, with planted gaps (13th) and zero prices (27th)."""
    day = F.col("l_shipdate").cast("date")

    def exact(c):
        return hundredths(c) / 100.0

    daily = lineitem.groupBy(F.col("l_returnflag").alias("series_id"), day.alias("trade_date")).agg(
        exact(F.col("l_extendedprice")).alias("_value"),
        exact(F.col("l_quantity")).alias("volume"),
        exact(F.col("l_tax") * 100).alias("_tax"),
        exact(F.col("l_discount") * 100).alias("_discount"),
        F.count(F.lit(1)).alias("_n"),
    )
    of_month = F.dayofmonth("trade_date")
    return daily.select(
        "series_id",
        "trade_date",
        F.when(of_month == 13, None).when(of_month == 27, 0.0).otherwise(F.col("_value") / F.col("volume")).alias("price"),
        "volume",
        (F.col("_tax") / F.col("_n")).alias("gas_price"),
        F.col("_n").cast("double").alias("pjm_load"),
        (F.col("_discount") / F.col("_n") - 5).alias("temperature"),
    )
