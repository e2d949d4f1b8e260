"""Inputs of the registered queries, once as DataFrames and once as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.scalars import uniform_hash
from gridtide.operators.cleaning import filter_positive_price
from gridtide.operators.curves import residuals
from gridtide.plans.timeline import SeriesOrder, windowed
from gridtide.sources.market import hundredths, market_daily

EVENTS = SeriesOrder(keys=("event_type",), ts="ts", tie=("event_id",))
# Line items as three long series, in blocks of the default size.
LINE_KEY = ("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINES = SeriesOrder(keys=("l_returnflag",), ts="l_shipdate", tie=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def market(spark: SparkSession, sf: str) -> DataFrame:
    """Three daily series with gaps and zero prices."""
    return market_daily(table(spark, sf, "lineitem"))


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """The market rows with a positive price."""
    return filter_positive_price(market(spark, sf))


def suppliers_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A daily price for every supplier: many series, together as long as the line items."""
    value, quantity = (hundredths(F.col(c)) for c in ("l_extendedprice", "l_quantity"))
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("series_id"), F.col("l_shipdate").cast("date").alias("trade_date")).agg(
        ((value / 100.0) / (quantity / 100.0)).alias("price"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Long series ordered by timestamps."""
    return table(spark, sf, "events").select("event_type", "ts", "event_id", F.col("value").alias("price"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item as one row of a long series, priced by its unit price."""
    return table(spark, sf, "lineitem").select(
        *LINE_KEY, "l_shipdate", "l_discount", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Binary labels with a score that overlaps between the classes and has ties (steps of 1/128)."""
    quality = F.col("quality").cast("int")
    score = quality * 0.25 + uniform_hash(42, F.col("doc_id")) * 0.75
    return table(spark, sf, "labels").select("doc_id", quality.alias("y"), (F.floor(score * 128) / 128).alias("p"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """True and predicted values: an order's total and the mean of its day, in 100,000s."""
    orders = table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice")
    total = hundredths(F.col("o_totalprice")) / 100.0
    daily = orders.groupBy("o_orderdate").agg((total / F.count(F.lit(1)) / 100000).alias("y_pred"))
    return orders.join(daily, "o_orderdate").select(
        "o_orderstatus", "o_orderkey", "o_orderdate", (F.col("o_totalprice") / 100000).alias("y_true"), "y_pred")


def rounded(df: DataFrame, places: int = 6, exact: tuple[str, ...] = ("price",)) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; raw prices stay as they are.

    The scaled value is rounded, as in the SQL, not the shortest decimal: half a last place may be told otherwise there.
    """
    scale = float(10 ** places)
    kinds = {f.name: f.dataType for f in df.schema if f.dataType.typeName() in ("double", "float") and f.name not in exact}
    return df.withColumns({c: (F.round(F.col(c) * scale) / scale).cast(kind) for c, kind in kinds.items()})


def scientific(df: DataFrame, columns: list[str]) -> DataFrame:
    """Seven digits of numbers that compound to any size."""
    return df.withColumns({c: F.format_string("%.6e", F.col(c) + F.lit(0.0)) for c in columns})


MARKET_SQL = """market AS (
SELECT series_id, trade_date,
       CASE WHEN extract(day FROM trade_date) = 13 THEN NULL
            WHEN extract(day FROM trade_date) = 27 THEN 0.0 ELSE raw_price END AS price,
       volume, gas_price, pjm_load, temperature
FROM (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS trade_date,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
               / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS raw_price,
             CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
             CAST(sum(CAST(l_tax*100 AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS gas_price,
             CAST(count(*) AS DOUBLE) AS pjm_load,
             CAST(sum(CAST(l_discount*100 AS DECIMAL(18,2))) AS DOUBLE)/count(*) - 5 AS temperature
      FROM lineitem GROUP BY l_returnflag, CAST(l_shipdate AS DATE)) m)"""

PRICED_SQL = f"{MARKET_SQL},\npriced AS (SELECT * FROM market WHERE price > 0)"

SUPPLIERS_SQL = """suppliers AS (
SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS trade_date,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS price
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""

LINES_SQL = """lines AS (
SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_extendedprice / l_quantity AS price FROM lineitem)"""
LINES_OVER = "PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"

EVENTS_SQL = "ev AS (SELECT event_type, ts, event_id, value AS price FROM events)"

SCORES_SQL = """scores AS (
SELECT doc_id, CAST(quality AS INTEGER) AS y,
       floor((quality * 0.25 + ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0 * 0.75) * 128) / 128 AS p
FROM labels)"""

PAIRS_SQL = """daily AS (
SELECT CAST(o_orderdate AS DATE) AS o_orderdate,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100000 AS y_pred
FROM orders GROUP BY 1),
pairs AS (
SELECT o.o_orderstatus, o.o_orderkey, CAST(o.o_orderdate AS DATE) AS o_orderdate,
       o.o_totalprice / 100000 AS y_true, d.y_pred
FROM orders o JOIN daily d ON CAST(o.o_orderdate AS DATE) = d.o_orderdate)"""


def event_order(spark: SparkSession, sf: str) -> SeriesOrder:
    """The order of events with its buckets looked up once for all steps of a query."""
    return EVENTS.resolved(events(spark, sf))


def naive_forecast(spark: SparkSession, sf: str, order: SeriesOrder = EVENTS) -> DataFrame:
    """Long series with the value before as the forecast, and the residual of it."""
    def previous(w):
        return {"y_pred": F.lag("price").over(w)}

    rows = windowed(events(spark, sf), previous, order=order, lookback=1).withColumnRenamed("price", "y_true")
    return residuals(rows.filter(F.col("y_pred").isNotNull()))


NAIVE_SQL = f"""{EVENTS_SQL},
shifted AS (SELECT event_type, ts, event_id, price AS y_true, lag(price) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y_pred FROM ev),
naive AS (SELECT *, y_true - y_pred AS residual,
       row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM shifted WHERE y_pred IS NOT NULL)"""
