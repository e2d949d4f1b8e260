"""Strategies, back-tests and trading metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.catalog.inputs import (EVENTS, EVENTS_SQL, LINE_KEY, LINES, LINES_SQL, MARKET_SQL, PRICED_SQL, SUPPLIERS_SQL, events, lines, market,
                                     priced, rounded, scientific, suppliers_daily)
from gridtide.operators import strategies as S
from gridtide.operators import trading as T
from gridtide.plans.backtest import backtest_report
from gridtide.plans.timeline import windowed

# ---- DuckDB views -------------------------------------------------------------------------------

def channel_sql(source: str = "priced", key: str = "series_id", ts: str = "trade_date", n: int = 14) -> str:
    over = f"PARTITION BY {key} ORDER BY {ts}"
    return f"""channel AS (
SELECT *, row_number() OVER o - 1 AS rn,
       CASE WHEN count(price) OVER f = {n} THEN quantile_cont(price, 0.2) OVER f END AS pct_low,
       CASE WHEN count(price) OVER f = {n} THEN quantile_cont(price, 0.8) OVER f END AS pct_high
FROM {source}
WINDOW o AS ({over}), f AS ({over} ROWS {n - 1} PRECEDING)),
signals AS (
SELECT *, CASE WHEN rn >= {n} AND price <= pct_low THEN 1 WHEN rn >= {n} AND price >= pct_high THEN -1 ELSE 0 END AS signal
FROM channel),
strategy AS (
SELECT *, coalesce(last_value(nullif(signal, 0) IGNORE NULLS) OVER ({over} ROWS UNBOUNDED PRECEDING), 0) AS position
FROM signals),
returns AS (
SELECT *, coalesce((lead(price) OVER o - price) / price, 0) AS actual_return,
       position * coalesce((lead(price) OVER o - price) / price, 0) AS strategy_return
FROM strategy WINDOW o AS ({over}))"""


LINES_BY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
CHANNEL = f"WITH {PRICED_SQL},\n{channel_sql()}"


def metrics_sql(r: str) -> str:
    return f"""count({r}) AS total_trades,
       round(coalesce(avg(CASE WHEN {r} > 0 THEN 1.0 ELSE 0.0 END), 0), 6) AS win_rate,
       round(coalesce(sum({r}), 0), 6) AS roi,
       round(coalesce(CASE WHEN stddev_pop({r}) > 0 THEN avg({r}) / stddev_pop({r}) * sqrt(252.0) END, 0), 6) AS sharpe,
       round(coalesce(avg({r}), 0), 6) AS avg_return"""


def breakout_sql(source: str = "priced", key: str = "series_id", ts: str = "trade_date") -> str:
    return f"""raw AS (
SELECT *, row_number() OVER o AS rn,
       CASE WHEN count(*) OVER past >= 20 AND lag(price, 1) OVER o > lag(price, 5) OVER o * 1.02
                 AND price > max(price) OVER past THEN 1
            WHEN count(*) OVER past >= 20 AND lag(price, 1) OVER o < lag(price, 5) OVER o * 0.98
                 AND price < min(price) OVER past THEN -1 END AS raw
FROM {source}
WINDOW o AS (PARTITION BY {key} ORDER BY {ts}),
       past AS (PARTITION BY {key} ORDER BY {ts} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
held AS (
SELECT *, coalesce(last_value(raw IGNORE NULLS)
                   OVER (PARTITION BY {key} ORDER BY {ts} ROWS UNBOUNDED PRECEDING), 0) AS position
FROM raw),
bos AS (
SELECT *, CASE WHEN position <> coalesce(lag(position) OVER o, 0) THEN position ELSE 0 END AS signal
FROM held WINDOW o AS (PARTITION BY {key} ORDER BY {ts}))"""


BOS = f"WITH {PRICED_SQL},\n{breakout_sql()}"

def balance_sql(views: str, source: str, key: str = "series_id", ts: str = "trade_date") -> str:
    """The account as a recursion over the trades of a series, the way a broker would book them."""
    return f"""WITH RECURSIVE {views},
{breakout_sql(source, key, ts)},
trades AS (
SELECT {key}, rn, price AS entry, signal, row_number() OVER (PARTITION BY {key} ORDER BY rn) AS k
FROM bos WHERE signal <> 0),
book AS (
SELECT {key}, k, rn, signal, entry, CAST(10000.0 AS DOUBLE) AS cash, 10000.0 / entry AS shares FROM trades WHERE k = 1
UNION ALL
SELECT t.{key}, t.k, t.rn, t.signal, t.entry,
       CASE WHEN b.signal = 1 THEN b.shares * t.entry ELSE b.cash - b.shares * t.entry END,
       CASE WHEN b.signal = 1 THEN b.shares * t.entry ELSE b.cash - b.shares * t.entry END / t.entry
FROM book b JOIN trades t ON t.{key} = b.{key} AND t.k = b.k + 1),
account AS (
SELECT s.* EXCLUDE (raw, rn), coalesce(b.shares, 0) AS shares,
       CASE WHEN s.position = 1 THEN b.shares * s.price
            WHEN s.position = -1 THEN b.cash - b.shares * s.price ELSE 10000.0 END AS balance
FROM bos s ASOF LEFT JOIN book b ON s.{key} = b.{key} AND s.rn >= b.rn)"""


BALANCE = balance_sql(PRICED_SQL, "priced")

PREDICTED = f"""WITH {PRICED_SQL},
predicted AS (
SELECT series_id, trade_date, lead(price) OVER o / price - 1 AS actual, price / lag(price) OVER o - 1 AS pred
FROM priced WINDOW o AS (PARTITION BY series_id ORDER BY trade_date))"""


# ---- Spark ---------------------------------------------------------------------------------------

def _channel(spark, sf):
    return S.percentile_strategy(priced(spark, sf).select("series_id", "trade_date", "price"))


def _returns(spark, sf):
    return T.strategy_returns(_channel(spark, sf))


def _bos(spark, sf):
    return S.bos_strategy(priced(spark, sf).select("series_id", "trade_date", "price"))


def _balance(spark, sf):
    return S.bos_balance(priced(spark, sf).select("series_id", "trade_date", "price"))


def _predicted(spark, sf):
    """Realised next return and, as a naive prediction, the latest return."""
    return windowed(
        priced(spark, sf).select("series_id", "trade_date", "price"),
        lambda w: {"actual": F.lead("price").over(w) / F.col("price") - 1,
                   "pred": F.col("price") / F.lag("price").over(w) - 1},
        lookback=1, lookahead=1).drop("price")


def backtest(spark, sf):
    return rounded(backtest_report(market(spark, sf), S.percentile_strategy))


def _events_strategy(spark, sf):
    return S.percentile_strategy(events(spark, sf), 20, order=EVENTS)


def _lines_balance(spark, sf):
    """The account over long series: three carried states, one after the other."""
    rows = lines(spark, sf)
    order = LINES.resolved(rows)
    out = S.bos_balance(order.cut(rows), order=order)
    return scientific(out.select(*LINE_KEY, "position", "signal", "balance"), ["balance"])


def _known(df):
    return df.filter("actual IS NOT NULL AND pred IS NOT NULL")


QUERIES = {
    "backtest_report": backtest,
    "backtest_report_bos": lambda s, d: rounded(
        backtest_report(market(s, d), S.bos_strategy, start="1996-01-01", end="1999-12-31")),
    "backtest_by_supplier": lambda s, d: rounded(backtest_report(suppliers_daily(s, d), S.percentile_strategy)),
    "backtest_events": lambda s, d: rounded(backtest_report(events(s, d), S.percentile_strategy, order=EVENTS, window=20)),
    "events_percentile_strategy": lambda s, d: _events_strategy(s, d).select("event_id", "signal", "position"),
    "events_bos_strategy": lambda s, d: S.bos_strategy(events(s, d), order=EVENTS).select("event_id", "signal", "position"),
    "backtest_lines": lambda s, d: rounded(backtest_report(lines(s, d), S.percentile_strategy, order=LINES)),
    "lines_bos_balance": _lines_balance,
    "rolling_percentile": lambda s, d: rounded(
        S.rolling_percentile(priced(s, d).select("series_id", "trade_date", "price"))),
    "rolling_percentile_250": lambda s, d: rounded(
        S.rolling_percentile(priced(s, d).select("series_id", "trade_date", "price"), 250)),
    "lines_percentile_2000": lambda s, d: rounded(
        S.rolling_percentile(lines(s, d).select(*LINE_KEY, "l_shipdate", "price"), 2000, order=LINES).drop("l_shipdate", "price")),
    "percentile_strategy": lambda s, d: rounded(_channel(s, d)),
    "detect_trend": lambda s, d: S.detect_trend(priced(s, d)).select("series_id", "trade_date", "trend"),
    "recent_high_low": lambda s, d: rounded(
        S.recent_high_low(priced(s, d)).select("series_id", "trade_date", "recent_high", "recent_low"), 4),
    "bos_strategy": lambda s, d: _bos(s, d),
    "bos_balance": lambda s, d: rounded(_balance(s, d), 4),
    "balance_roi": lambda s, d: rounded(T.balance_roi(_balance(s, d))),
    "signal_events": lambda s, d: S.signal_events(_channel(s, d)).select("series_id", "trade_date", "price", "signal"),
    "strategy_returns": lambda s, d: rounded(
        _returns(s, d).select("series_id", "trade_date", "position", "actual_return", "strategy_return")),
    "compounded_roi": lambda s, d: scientific(T.compounded_roi(_returns(s, d), by=["series_id"]), ["roi_pct"]),
    "cumulative_return_curve": lambda s, d: scientific(
        T.cumulative_return_curve(_returns(s, d)).select("series_id", "trade_date", "market_pct", "strategy_pct"),
        ["market_pct", "strategy_pct"]),
    "trading_metrics_from_frame": lambda s, d: rounded(
        T.trading_metrics_from_frame(_returns(s, d), "strategy_return", by=["series_id", "position"])),
    "algo_return_summary": lambda s, d: rounded(
        T.algo_return_summary(_returns(s, d), "strategy_return", by=["series_id"])),
    "position_from_prediction": lambda s, d: _known(_predicted(s, d)).select(
        "series_id", "trade_date", T.position_from_prediction(F.col("pred")).alias("side"),
        T.position_from_prediction(F.col("pred"), "threshold").alias("long_only")),
    "trading_metrics": lambda s, d: rounded(T.trading_metrics(_predicted(s, d), by=["series_id"])),
    "trading_metrics_threshold": lambda s, d: rounded(
        T.trading_metrics(_predicted(s, d), rule="threshold", by=["series_id"])),
    "trading_frame": lambda s, d: rounded(scientific(
        T.trading_frame(_known(_predicted(s, d))), ["cumulative_return", "cumulative_actual"])),
}

ORACLES = {
    "backtest_report": f"{CHANNEL} SELECT series_id, {metrics_sql('strategy_return')} FROM returns GROUP BY series_id",
    "backtest_report_bos": f"""WITH {MARKET_SQL},
priced AS (SELECT * FROM market WHERE price > 0 AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'),
{breakout_sql()},
r AS (SELECT series_id, position * coalesce((lead(price) OVER (PARTITION BY series_id ORDER BY trade_date) - price) / price, 0) AS r FROM bos)
SELECT series_id, {metrics_sql('r')} FROM r GROUP BY series_id""",
    "backtest_by_supplier": f"""WITH {SUPPLIERS_SQL}, {channel_sql('suppliers')}
SELECT series_id, {metrics_sql('strategy_return')} FROM returns GROUP BY series_id""",
    "backtest_events": f"""WITH {EVENTS_SQL}, positive AS (SELECT * FROM ev WHERE price > 0), {channel_sql('positive', 'event_type', 'ts, event_id', 20)}
SELECT event_type, {metrics_sql('strategy_return')} FROM returns GROUP BY event_type""",
    "events_percentile_strategy": f"""WITH {EVENTS_SQL}, {channel_sql('ev', 'event_type', 'ts, event_id', 20)}
SELECT event_id, signal, position FROM strategy""",
    "events_bos_strategy": f"""WITH {EVENTS_SQL}, {breakout_sql('ev', 'event_type', 'ts, event_id')}
SELECT event_id, signal, position FROM bos""",
    "backtest_lines": f"""WITH {LINES_SQL}, {channel_sql('lines', 'l_returnflag', LINES_BY)}
SELECT l_returnflag, {metrics_sql('strategy_return')} FROM returns GROUP BY l_returnflag""",
    "lines_bos_balance": balance_sql(LINES_SQL, "lines", "l_returnflag", LINES_BY) + f"""
SELECT {', '.join(LINE_KEY)}, position, signal, printf('%.6e', balance) AS balance FROM account""",
    "rolling_percentile": f"""{CHANNEL} SELECT series_id, trade_date, price,
       round(pct_low, 6) AS pct_low, round(pct_high, 6) AS pct_high FROM channel""",
    "rolling_percentile_250": f"""WITH {PRICED_SQL}, {channel_sql(n=250)} SELECT series_id, trade_date, price,
       round(pct_low, 6) AS pct_low, round(pct_high, 6) AS pct_high FROM channel""",
    "lines_percentile_2000": f"""WITH {LINES_SQL}, {channel_sql('lines', 'l_returnflag', LINES_BY, 2000)}
SELECT {', '.join(LINE_KEY)}, round(pct_low, 6) AS pct_low, round(pct_high, 6) AS pct_high FROM channel""",
    "percentile_strategy": f"""{CHANNEL} SELECT series_id, trade_date, price, round(pct_low, 6) AS pct_low,
       round(pct_high, 6) AS pct_high, signal, position FROM strategy""",
    "detect_trend": f"""WITH {PRICED_SQL} SELECT series_id, trade_date,
       CASE WHEN price > lag(price, 4) OVER o * 1.02 THEN 'uptrend'
            WHEN price < lag(price, 4) OVER o * 0.98 THEN 'downtrend' ELSE 'sideways' END AS trend
FROM priced WINDOW o AS (PARTITION BY series_id ORDER BY trade_date)""",
    "recent_high_low": f"""WITH {PRICED_SQL} SELECT series_id, trade_date, round(max(price) OVER f, 4) AS recent_high,
       round(min(price) OVER f, 4) AS recent_low
FROM priced WINDOW f AS (PARTITION BY series_id ORDER BY trade_date ROWS 19 PRECEDING)""",
    "bos_strategy": f"{BOS} SELECT series_id, trade_date, price, position, signal FROM bos",
    "bos_balance": f"""{BALANCE} SELECT series_id, trade_date, price, position, signal,
       round(shares, 4) AS shares, round(balance, 4) AS balance FROM account""",
    "balance_roi": f"""{BALANCE} SELECT series_id, round((max_by(balance, trade_date) - 10000.0) / 10000.0 * 100, 6) AS balance_roi
FROM account GROUP BY series_id""",
    "signal_events": f"{CHANNEL} SELECT series_id, trade_date, price, signal FROM signals WHERE signal <> 0",
    "strategy_returns": f"""{CHANNEL} SELECT series_id, trade_date, position, round(actual_return, 6) AS actual_return,
       round(strategy_return, 6) AS strategy_return FROM returns""",
    "compounded_roi": f"""{CHANNEL} SELECT series_id, printf('%.6e', (product(1 + strategy_return) - 1) * 100) AS roi_pct
FROM returns GROUP BY series_id""",
    "cumulative_return_curve": f"""{CHANNEL} SELECT series_id, trade_date,
       printf('%.6e', (product(1 + actual_return) OVER f - 1) * 100) AS market_pct,
       printf('%.6e', (product(1 + strategy_return) OVER f - 1) * 100) AS strategy_pct
FROM returns
WINDOW f AS (PARTITION BY series_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)""",
    "trading_metrics_from_frame": f"""{CHANNEL} SELECT series_id, position, {metrics_sql('strategy_return')}
FROM returns GROUP BY series_id, position""",
    "algo_return_summary": f"""{CHANNEL} SELECT series_id, round(avg(strategy_return), 6) AS algo_returns_mean,
       round(stddev_pop(strategy_return), 6) AS algo_returns_std FROM returns GROUP BY series_id""",
    "position_from_prediction": f"""{PREDICTED} SELECT series_id, trade_date, CASE WHEN pred > 0 THEN 1 ELSE -1 END AS side,
       CASE WHEN pred > 0 THEN 1 ELSE 0 END AS long_only FROM predicted WHERE actual IS NOT NULL AND pred IS NOT NULL""",
    "trading_metrics": f"""{PREDICTED}, r AS (SELECT series_id, CASE WHEN pred > 0 THEN 1 ELSE -1 END * actual AS r
FROM predicted WHERE actual IS NOT NULL AND pred IS NOT NULL)
SELECT series_id, {metrics_sql('r')} FROM r GROUP BY series_id""",
    "trading_metrics_threshold": f"""{PREDICTED}, r AS (SELECT series_id, CASE WHEN pred > 0 THEN 1 ELSE 0 END * actual AS r
FROM predicted WHERE actual IS NOT NULL AND pred IS NOT NULL)
SELECT series_id, {metrics_sql('r')} FROM r GROUP BY series_id""",
    "trading_frame": f"""{PREDICTED}, r AS (SELECT *, CASE WHEN pred > 0 THEN 1 ELSE -1 END AS position,
       CASE WHEN pred > 0 THEN 1 ELSE -1 END * actual AS algo_return
FROM predicted WHERE actual IS NOT NULL AND pred IS NOT NULL)
SELECT series_id, trade_date, round(actual, 6) AS actual, round(pred, 6) AS pred, position, round(algo_return, 6) AS algo_return,
       printf('%.6e', product(1 + algo_return) OVER f - 1) AS cumulative_return,
       printf('%.6e', product(1 + actual) OVER f - 1) AS cumulative_actual
FROM r WINDOW f AS (PARTITION BY series_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)""",
}
