"""Cleaning, features, targets, splits, scaling and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.catalog.inputs import (EVENTS, EVENTS_SQL, LINE_KEY, LINES, LINES_OVER, LINES_SQL, MARKET_SQL, PRICED_SQL, events, lines, market,
                                     priced, rounded)
from gridtide.operators import cleaning as C
from gridtide.operators import features as X
from gridtide.operators import scaling as Z
from gridtide.operators import sequences as Q
from gridtide.operators import statistics as A
from gridtide.operators import targets as Y
from gridtide.plans.dataset import make_dataset
from gridtide.plans.timeline import windowed
from gridtide.sources.market import CORE, CORE_COLUMNS, core_projection, numeric_projection

KEY = ("series_id", "trade_date")
O = "WINDOW o AS (PARTITION BY series_id ORDER BY trade_date)"  # noqa: E741
W = "PARTITION BY series_id ORDER BY trade_date"
FLAT = 1e-6


def raw_named(rows):
    """Market rows under the headings of the raw file."""
    raw = {short: long for long, short in CORE_COLUMNS.items()}
    return rows.select("series_id", F.col("trade_date").alias("Trade Date"), *(F.col(c).alias(raw[c]) for c in CORE))


def _scaled_by_table(spark, sf):
    """One scaler for all series, fitted as a one-row table and applied to every row."""
    rows = _split(spark, sf)
    return Z.apply_scaler(rows, Z.fit_scaler(rows, CORE, by=[]), CORE, by=[]).select(*KEY, *CORE)


def _only(df, *columns):
    return rounded(df.select(*KEY, *columns))


# ---- features ------------------------------------------------------------------------------------

RAW_PRICES = ("price", "price_lag1", "price_lag2", "price_lag3")
LEVELS = ["price_rolling_mean_7d", "volume_rolling_mean_7d", "price_rolling_std_7d"]


def change(c: str, k: int = 1) -> str:
    return f"{c} / nullif(lag({c}, {k}) OVER o, 0) - 1"


def samp(expr: str, w: str) -> str:
    """A sample deviation that is missing for a single value."""
    return f"CASE WHEN count({expr}) OVER {w} > 1 THEN stddev_samp({expr}) OVER {w} END"


def v1_sql(source: str, flag: str = "TRUE") -> str:
    return f"""placed AS (SELECT *, row_number() OVER o - 1 AS place, {change('price')} AS price_return FROM {source} {O}),
v1_all AS (
SELECT series_id, trade_date, price, volume, gas_price, pjm_load, temperature, {flag} AS has_real_price,
       day(trade_date) AS "Day", month(trade_date) AS "Month", year(trade_date) AS "Year",
       isodow(trade_date) - 1 AS "Weekday", CASE WHEN isodow(trade_date) < 6 THEN 1 ELSE 0 END AS "IS_WORKDAY", price_return,
       {change('volume')} AS volume_pct_change, {change('gas_price')} AS gas_price_pct_change,
       {change('pjm_load')} AS pjm_load_pct_change, {change('temperature')} AS temperature_pct_change,
       lag(price) OVER o AS price_lag1, lag(volume) OVER o AS volume_lag1, lag(gas_price) OVER o AS gas_price_lag1,
       avg(price) OVER w7 AS price_rolling_mean_7d, {samp('price', 'w7')} AS price_rolling_std_7d,
       avg(volume) OVER w7 AS volume_rolling_mean_7d, {change('price', 3)} AS momentum_3d, {change('price', 7)} AS momentum_7d,
       CASE WHEN max(price) OVER w14 - min(price) OVER w14 > 0
            THEN (price - min(price) OVER w14) / (max(price) OVER w14 - min(price) OVER w14) ELSE 0.5 END AS price_position,
       CASE WHEN count(price) OVER w14 = 14 THEN regr_slope(price, place) OVER w14 END AS trend_slope,
       {samp('price_return', 'w7')} AS volatility_7d, {samp('price_return', 'w30')} AS volatility_30d
FROM placed WINDOW o AS ({W}), w7 AS ({W} ROWS 6 PRECEDING), w14 AS ({W} ROWS 13 PRECEDING), w30 AS ({W} ROWS 29 PRECEDING)),
v1 AS (SELECT * FROM v1_all WHERE price_return IS NOT NULL AND volume_pct_change IS NOT NULL AND gas_price_pct_change IS NOT NULL
       AND pjm_load_pct_change IS NOT NULL AND temperature_pct_change IS NOT NULL AND momentum_7d IS NOT NULL
       AND trend_slope IS NOT NULL AND volatility_7d IS NOT NULL AND volatility_30d IS NOT NULL AND price_rolling_std_7d IS NOT NULL)"""


V1_DOUBLES = ("price_return volume_pct_change gas_price_pct_change pjm_load_pct_change temperature_pct_change price_lag1 volume_lag1 "
              "gas_price_lag1 price_rolling_mean_7d price_rolling_std_7d volume_rolling_mean_7d momentum_3d momentum_7d "
              "price_position trend_slope volatility_7d volatility_30d volume gas_price pjm_load temperature").split()


def v2_sql(source: str) -> str:
    parts, needed = [], []
    for c in CORE:
        parts.append(f"{change(c)} AS {c}_return, " + ", ".join(f"lag({c}, {k}) OVER o AS {c}_lag{k}" for k in (1, 2, 3))
                     + f", avg({c}) OVER w7 AS {c}_roll7_mean, {samp(c, 'w7')} AS {c}_roll7_std")
        needed += [f"{c}_return IS NOT NULL", f"{c}_lag3 IS NOT NULL", f"{c} IS NOT NULL", f"{c}_roll7_std IS NOT NULL"]
    return f"""v2_all AS (
SELECT series_id, trade_date, price, volume, gas_price, pjm_load, temperature, {', '.join(parts)},
       day(trade_date) AS day, month(trade_date) AS month, year(trade_date) AS year, isodow(trade_date) - 1 AS weekday,
       quarter(trade_date) AS quarter, dayofyear(trade_date) AS day_of_year
FROM {source} WINDOW o AS ({W}), w7 AS ({W} ROWS 6 PRECEDING)),
v2 AS (SELECT * FROM v2_all WHERE {' AND '.join(needed)})"""


V2_DOUBLES = [*CORE, *X.features_v2_names(CORE)]
CALENDAR_V2 = "day month year weekday quarter day_of_year".split()


def rounds(columns, places=6, exact=("price",)) -> str:
    return ", ".join(c if c in exact else f"round({c}, {places}) AS {c}" for c in columns)


# Cleaned rows: complete, positive price, no unchanged price.
CLEAN_SQL = f"""{MARKET_SQL},
kept AS (SELECT * FROM market WHERE price > 0 AND volume IS NOT NULL AND gas_price IS NOT NULL AND pjm_load IS NOT NULL AND temperature IS NOT NULL),
moved AS (SELECT *, abs(price - lag(price) OVER o) AS change FROM kept {O}),
flat AS (SELECT series_id, bool_or(coalesce(change < {FLAT}, FALSE)) AS has_flat FROM moved GROUP BY series_id),
clean AS (SELECT m.* EXCLUDE (change) FROM moved m JOIN flat f USING (series_id) WHERE NOT f.has_flat OR m.change >= {FLAT})"""

LABELLED_SQL = f"""labelled AS (
SELECT *, lead(price) OVER o / price - 1 AS ret_fwd, row_number() OVER o - 1 AS pos FROM v2 {O}),
known AS (SELECT *, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM labelled WHERE ret_fwd IS NOT NULL {O}),
split AS (SELECT *, CASE WHEN ret_fwd > 0 THEN 1 ELSE 0 END AS y_target,
       CASE WHEN idx < n - floor(n * 0.15) - floor(n * 0.15) THEN 'train'
            WHEN idx < n - floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM known)"""

SPLIT_SQL = f"""{PRICED_SQL},
placed AS (SELECT *, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM priced {O}),
split AS (SELECT *, CASE WHEN idx < n - floor(n * 0.15) - floor(n * 0.15) THEN 'train'
            WHEN idx < n - floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM placed)"""


def _split(spark, sf):
    return Y.split_chronological(priced(spark, sf))


def _labelled(spark, sf, task="sign"):
    return Y.drop_unlabelled(Y.build_targets(priced(spark, sf), task))


def _scaler_sql(kind: str) -> str:
    cols = []
    for c in CORE:
        x = f"CASE WHEN split = 'train' THEN {c} END"
        off, width = (f"avg({x})", f"stddev_pop({x})") if kind == "standard" else (f"min({x})", f"max({x}) - min({x})")
        over = "OVER (PARTITION BY series_id)"
        width = width.replace(")", f") {over}") if kind == "standard" else f"max({x}) {over} - min({x}) {over}"
        off = off + f" {over}"
        cols.append(f"round(({c} - {off}) / coalesce(nullif({width}, 0), 1), 6) AS {c}")
    return f"WITH {SPLIT_SQL} SELECT series_id, trade_date, split, {', '.join(cols)} FROM split"


SEQ = ["price", "volume"]


def _sequence_sql(first: str, last: str) -> str:
    return f"""WITH {SPLIT_SQL}, windows AS (
SELECT series_id, trade_date, split, list([price, volume]) OVER (PARTITION BY series_id, split ORDER BY trade_date
       ROWS BETWEEN {first} AND {last}) AS seq FROM split)
SELECT series_id, trade_date, split, seq FROM windows WHERE len(seq) = 14"""


def _fill(spark, sf, fill):
    return fill(market(spark, sf), ["price"]).select(*KEY, "price")


def _events_feature(spark, sf):
    return X.rolling_mean(events(spark, sf), ["price"], 30, order=EVENTS)


def _lines_features(spark, sf):
    """Look-back and look-ahead windows over long series in one layout."""
    out = windowed(lines(spark, sf), lambda w: {
        "mean29": F.avg("price").over(w.rowsBetween(-28, 0)), "lag9": F.lag("price", 9).over(w),
        "ahead": F.lead("price", 3).over(w)}, order=LINES, lookback=28, lookahead=3)
    return rounded(out.select(*LINE_KEY, "mean29", "lag9", "ahead"), exact=("lag9", "ahead"))


def _lines_fill(spark, sf):
    gaps = lines(spark, sf).withColumn("price", F.when(F.col("l_discount") > 0.045, F.col("price")))
    order = LINES.resolved(gaps)
    forward = order.cut(C.forward_fill(gaps, ["price"], order))
    return C.backward_fill(forward, ["price"], order).select(*LINE_KEY, "price")


def _dataset(spark, sf, **options):
    return make_dataset(market(spark, sf), **options)


def _dataset_rows(spark, sf):
    data = _dataset(spark, sf)
    return rounded(data.rows.select(*KEY, "idx", "split", "y_target", "ret_fwd", *V2_DOUBLES, *CALENDAR_V2), 4, exact=())


def _dataset_sql() -> str:
    names = [*V2_DOUBLES, *CALENDAR_V2]
    cols = []
    for c in names:
        x = f"CASE WHEN split = 'train' THEN {c} END"
        over = "OVER (PARTITION BY series_id)"
        cols.append(f"round(({c} - avg({x}) {over}) / stddev_pop({x}) {over}, 4) AS {c}")
    return f"""WITH {CLEAN_SQL}, {v2_sql('clean')}, {LABELLED_SQL}
SELECT series_id, trade_date, idx, split, y_target, round(ret_fwd, 4) AS ret_fwd, {', '.join(cols)} FROM split"""


V1_INPUT_SQL = f"""{MARKET_SQL},
filled AS (SELECT series_id, trade_date, coalesce(price > 0, FALSE) AS has_real_price,
       last_value(price IGNORE NULLS) OVER f AS price, volume, gas_price, pjm_load, temperature
       FROM market WINDOW f AS ({W} ROWS UNBOUNDED PRECEDING)),
numbered AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM filled {O}),
means AS (SELECT series_id, avg(price) FILTER (price > 0 AND i < n - floor(n * 0.15) - floor(n * 0.15)) AS m FROM numbered GROUP BY series_id),
repaired AS (SELECT a.* REPLACE (CASE WHEN a.price = 0 THEN m.m ELSE a.price END AS price) FROM numbered a JOIN means m USING (series_id))"""


def _v1_rows(spark, sf):
    data = make_dataset(market(spark, sf), "price", features_version=1, scaler=None)
    return rounded(data.rows.select(*KEY, "split", "ret_fwd", "price", "price_return", "volatility_30d", "trend_slope"), 4, exact=("price",))


QUERIES = {
    "core_projection": lambda s, d: core_projection(raw_named(market(s, d))).select(*KEY, *CORE),
    "numeric_projection": lambda s, d: numeric_projection(market(s, d), KEY),
    "real_price_flag": lambda s, d: C.real_price_flag(market(s, d)).select(*KEY, "has_real_price"),
    "filter_real_price": lambda s, d: C.filter_real_price(C.real_price_flag(market(s, d))).select(*KEY, "price"),
    "drop_missing_critical": lambda s, d: C.drop_missing_critical(market(s, d)),
    "cleaning_counts": lambda s, d: C.cleaning_counts(market(s, d), by=["series_id"]),
    "filter_positive_price": lambda s, d: priced(s, d),
    "drop_zero_change": lambda s, d: C.drop_zero_change(C.drop_missing_critical(market(s, d))).select(*KEY, "price"),
    "drop_any_null": lambda s, d: C.drop_any_null(market(s, d)),
    "inf_to_null": lambda s, d: _only(C.inf_to_null(
        market(s, d).withColumn("ratio", F.when(F.col("temperature") == 0, float("inf")).otherwise(
            F.lit(1.0) / F.when(F.col("temperature") != 0, F.col("temperature"))))), "ratio"),
    "replace_zero_price": lambda s, d: rounded(C.replace_zero_price(market(s, d)).select(*KEY, "price"), exact=()),
    "replace_zero_price_table": lambda s, d: rounded(C.replace_zero_price(market(s, d), per=False).select(*KEY, "price"), exact=()),
    "replace_zero_price_train_only": lambda s, d: rounded(
        C.replace_zero_price_train_only(Y.split_chronological(market(s, d))).select(*KEY, "price"), exact=()),
    "date_range_filter": lambda s, d: C.date_range_filter(market(s, d), "1996-03-01", "1997-02-28").select(*KEY, "price"),
    "quality_assertions": lambda s, d: C.count_violations(market(s, d), CORE),
    "forward_fill": lambda s, d: _fill(s, d, C.forward_fill),
    "backward_fill": lambda s, d: _fill(s, d, C.backward_fill),
    "lag_features": lambda s, d: X.lag_features(priced(s, d), CORE, (1, 2, 3)),
    "price_diff": lambda s, d: _only(X.price_diff(priced(s, d)), "price_change"),
    "pct_change": lambda s, d: _only(X.pct_change(market(s, d)), *(f"{c}_return" for c in CORE)),
    "momentum": lambda s, d: _only(X.momentum(priced(s, d)), "momentum_3d", "momentum_7d"),
    "rolling_mean": lambda s, d: _only(X.rolling_mean(market(s, d), ["price", "volume"]), *LEVELS[:2]),
    "rolling_std": lambda s, d: rounded(X.rolling_std(market(s, d), ["price"]).select(*KEY, LEVELS[2]), 4),
    "volatility": lambda s, d: _only(X.volatility(priced(s, d)), "volatility_7d", "volatility_30d"),
    "price_position": lambda s, d: _only(X.price_position(priced(s, d)), "price_position"),
    "trend_slope": lambda s, d: rounded(X.trend_slope(priced(s, d)).select(*KEY, "trend_slope"), 4),
    "calendar_features": lambda s, d: X.calendar_features(market(s, d).select(*KEY)),
    "feature_frame_v1": lambda s, d: rounded(X.feature_frame_v1(priced(s, d)), 5, RAW_PRICES),
    "feature_frame_v2": lambda s, d: rounded(X.feature_frame_v2(priced(s, d)), 5, RAW_PRICES),
    "exog_returns": lambda s, d: _only(X.exog_returns(market(s, d)), "price_move"),
    "events_rolling_mean": lambda s, d: rounded(
        _events_feature(s, d).select("event_type", "event_id", "price_rolling_mean_30d"), 4),
    "events_pct_change": lambda s, d: rounded(
        X.pct_change(events(s, d), ["price"], order=EVENTS).select("event_type", "event_id", "price_return"), 4),
    "lines_features": _lines_features,
    "lines_forward_fill": _lines_fill,
    "lines_split": lambda s, d: Y.split_chronological(lines(s, d), order=LINES).select(*LINE_KEY, "idx", "split"),
    "forward_return": lambda s, d: _only(Y.forward_return(priced(s, d)), "ret_fwd"),
    "forward_return_horizon": lambda s, d: _only(Y.forward_return(priced(s, d), horizon=5), "ret_fwd"),
    "target_sign": lambda s, d: Y.build_targets(priced(s, d), "sign").select(*KEY, "y_target"),
    "target_3class": lambda s, d: Y.build_targets(priced(s, d), "sign_3class", flat_threshold=0.02).select(*KEY, "y_target"),
    "target_price": lambda s, d: _only(Y.build_targets(priced(s, d), "price"), "y_target"),
    "target_volatility": lambda s, d: _only(Y.build_targets(priced(s, d), "volatility"), "y_target"),
    "drop_unlabelled": lambda s, d: _only(_labelled(s, d, "price"), "y_target"),
    "split_chronological": lambda s, d: _split(s, d).select(*KEY, "idx", "split"),
    "split_chronological_by_date": lambda s, d: Y.split_chronological(priced(s, d), by="date").select(*KEY, "idx", "split"),
    "split_rolling_window": lambda s, d: Y.split_rolling_window(priced(s, d), 0.5).select(*KEY, "idx", "split"),
    "time_series_folds": lambda s, d: Y.time_series_folds(priced(s, d)).select(*KEY, "idx", "fold"),
    "split_counts": lambda s, d: Y.split_counts(_split(s, d), by=["series_id"]),
    "union_splits": lambda s, d: Y.union_splits(_split(s, d)).select(*KEY, "split"),
    "standard_scale": lambda s, d: rounded(Z.standard_scale(_split(s, d), CORE).select(*KEY, "split", *CORE), exact=()),
    "minmax_scale": lambda s, d: rounded(Z.minmax_scale(_split(s, d), CORE).select(*KEY, "split", *CORE), exact=()),
    "scalar_broadcast": lambda s, d: rounded(_scaled_by_table(s, d), 4, exact=()),
    "balance_downsample": lambda s, d: Y.balance_downsample(_labelled(s, d, "sign")).select(*KEY, "y_target"),
    "sequences_next": lambda s, d: Q.sequences_next(_split(s, d), SEQ).select(*KEY, "split", "seq"),
    "sequences_same": lambda s, d: Q.sequences_same(_split(s, d), SEQ).select(*KEY, "split", "seq"),
    "sequence_last_step": lambda s, d: Q.sequence_last_step(Q.sequences_same(_split(s, d), SEQ)).select(*KEY, "features"),
    "make_dataset": _dataset_rows,
    "make_dataset_v1": _v1_rows,
    "price_summary": lambda s, d: rounded(A.price_summary(market(s, d))),
    "class_distribution": lambda s, d: rounded(A.class_distribution(_labelled(s, d, "sign"), by=["series_id"])),
    "class_balance_ratio": lambda s, d: rounded(A.class_balance_ratio(_labelled(s, d, "sign"), by=["series_id"])),
    "zero_change_share": lambda s, d: rounded(A.zero_change_share(market(s, d))),
    "target_summary": lambda s, d: rounded(A.target_summary(_labelled(s, d, "price"), by=["series_id"])),
    "feature_target_corr": lambda s, d: rounded(A.feature_target_corr(_labelled(s, d, "price"), CORE)),
    "topk_features": lambda s, d: rounded(A.topk_features(_labelled(s, d, "price"), CORE, 3)),
    "class_weights": lambda s, d: rounded(A.class_weights(_labelled(s, d, "sign"), by=["series_id"])),
    "sort_by_date": lambda s, d: A.sort_by_date(market(s, d)).select(*KEY, "price"),
    "head_preview": lambda s, d: A.head_preview(market(s, d)),
}

LAB = f"""WITH {PRICED_SQL},
fwd AS (SELECT *, lead(price) OVER o / price - 1 AS ret_fwd FROM priced {O}),
lab AS (SELECT *, CASE WHEN ret_fwd > 0 THEN 1 ELSE 0 END AS y_target FROM fwd WHERE ret_fwd IS NOT NULL)"""

ORACLES = {
    "core_projection": f"WITH {MARKET_SQL} SELECT * FROM market",
    "numeric_projection": f"WITH {MARKET_SQL} SELECT * FROM market",
    "real_price_flag": f"WITH {MARKET_SQL} SELECT series_id, trade_date, coalesce(price > 0, FALSE) AS has_real_price FROM market",
    "filter_real_price": f"WITH {MARKET_SQL} SELECT series_id, trade_date, price FROM market WHERE price IS NOT NULL AND price > 0",
    "drop_missing_critical": f"WITH {MARKET_SQL} SELECT * FROM market WHERE price IS NOT NULL",
    "cleaning_counts": f"""WITH {MARKET_SQL} SELECT series_id, count(*) AS rows, count(*) FILTER (price IS NULL) AS missing_rows,
       count(*) FILTER (price <= 0) AS bad_price_rows, count(*) FILTER (price > 0) AS clean_rows FROM market GROUP BY series_id""",
    "filter_positive_price": f"WITH {PRICED_SQL} SELECT * FROM priced",
    "drop_zero_change": f"""WITH {MARKET_SQL}, kept AS (SELECT * FROM market WHERE price IS NOT NULL),
moved AS (SELECT *, abs(price - lag(price) OVER o) AS change FROM kept {O}),
flat AS (SELECT series_id, count(*) FILTER (change < {FLAT}) AS zeros FROM moved GROUP BY series_id)
SELECT series_id, trade_date, price FROM moved JOIN flat USING (series_id) WHERE zeros = 0 OR change >= {FLAT}""",
    "drop_any_null": f"WITH {MARKET_SQL} SELECT * FROM market WHERE price IS NOT NULL",
    "inf_to_null": f"""WITH {MARKET_SQL} SELECT series_id, trade_date, round(1.0 / nullif(temperature, 0), 6) AS ratio FROM market""",
    "replace_zero_price": f"""WITH {MARKET_SQL}, m AS (SELECT series_id, avg(price) AS mean FROM market WHERE price > 0 GROUP BY series_id)
SELECT series_id, trade_date, round(CASE WHEN price = 0 THEN mean ELSE price END, 6) AS price FROM market JOIN m USING (series_id)""",
    "replace_zero_price_table": f"""WITH {MARKET_SQL}, m AS (SELECT avg(price) AS mean FROM market WHERE price > 0)
SELECT series_id, trade_date, round(CASE WHEN price = 0 THEN mean ELSE price END, 6) AS price FROM market, m""",
    "replace_zero_price_train_only": f"""WITH {MARKET_SQL},
placed AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM market {O}),
m AS (SELECT series_id, avg(price) AS mean FROM placed WHERE price > 0 AND i < n - floor(n * 0.15) - floor(n * 0.15) GROUP BY series_id)
SELECT series_id, trade_date, round(CASE WHEN price = 0 THEN mean ELSE price END, 6) AS price FROM placed JOIN m USING (series_id)""",
    "date_range_filter": f"""WITH {MARKET_SQL} SELECT series_id, trade_date, price FROM market
WHERE trade_date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'""",
    "quality_assertions": f"""WITH {MARKET_SQL} SELECT count(*) AS rows, count(*) FILTER (trade_date IS NULL) AS null_time,
       count(*) - count(DISTINCT (series_id, trade_date)) AS repeated_time,
       {', '.join(f"count(*) FILTER ({c} IS NULL) AS null_{c}, count(*) FILTER (isinf({c}) OR isnan({c})) AS nonfinite_{c}" for c in CORE)}
FROM market""",
    "forward_fill": f"""WITH {MARKET_SQL} SELECT series_id, trade_date,
       last_value(price IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS price FROM market""",
    "backward_fill": f"""WITH {MARKET_SQL} SELECT series_id, trade_date,
       first_value(price IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS price FROM market""",
    "lag_features": f"""WITH {PRICED_SQL} SELECT *, {', '.join(f"lag({c}, {k}) OVER o AS {c}_lag{k}" for c in CORE for k in (1, 2, 3))}
FROM priced {O}""",
    "price_diff": f"WITH {PRICED_SQL} SELECT series_id, trade_date, round(price - lag(price) OVER o, 6) AS price_change FROM priced {O}",
    "pct_change": f"""WITH {MARKET_SQL} SELECT series_id, trade_date,
       {', '.join(f"round({change(c)}, 6) AS {c}_return" for c in CORE)} FROM market {O}""",
    "momentum": f"""WITH {PRICED_SQL} SELECT series_id, trade_date, round({change('price', 3)}, 6) AS momentum_3d,
       round({change('price', 7)}, 6) AS momentum_7d FROM priced {O}""",
    "rolling_mean": f"""WITH {MARKET_SQL} SELECT series_id, trade_date, round(avg(price) OVER f, 6) AS price_rolling_mean_7d,
       round(avg(volume) OVER f, 6) AS volume_rolling_mean_7d FROM market WINDOW f AS ({W} ROWS 6 PRECEDING)""",
    "rolling_std": f"""WITH {MARKET_SQL} SELECT series_id, trade_date, round({samp('price', 'f')}, 4) AS price_rolling_std_7d
FROM market WINDOW f AS ({W} ROWS 6 PRECEDING)""",
    "volatility": f"""WITH {PRICED_SQL}, r AS (SELECT *, {change('price')} AS ret FROM priced {O})
SELECT series_id, trade_date, round({samp('ret', 'w7')}, 6) AS volatility_7d, round({samp('ret', 'w30')}, 6) AS volatility_30d
FROM r WINDOW w7 AS ({W} ROWS 6 PRECEDING), w30 AS ({W} ROWS 29 PRECEDING)""",
    "price_position": f"""WITH {PRICED_SQL} SELECT series_id, trade_date, round(CASE WHEN max(price) OVER f > min(price) OVER f
       THEN (price - min(price) OVER f) / (max(price) OVER f - min(price) OVER f) ELSE 0.5 END, 6) AS price_position
FROM priced WINDOW f AS ({W} ROWS 13 PRECEDING)""",
    "trend_slope": f"""WITH {PRICED_SQL}, placed AS (SELECT *, row_number() OVER o AS i FROM priced {O})
SELECT series_id, trade_date, round(CASE WHEN count(price) OVER f = 14 THEN regr_slope(price, i) OVER f END, 4) AS trend_slope
FROM placed WINDOW f AS ({W} ROWS 13 PRECEDING)""",
    "calendar_features": f"""WITH {MARKET_SQL} SELECT series_id, trade_date, day(trade_date) AS day, month(trade_date) AS month,
       year(trade_date) AS year, isodow(trade_date) - 1 AS weekday, quarter(trade_date) AS quarter,
       dayofyear(trade_date) AS day_of_year, CASE WHEN isodow(trade_date) < 6 THEN 1 ELSE 0 END AS is_workday FROM market""",
    "feature_frame_v1": f"""WITH {PRICED_SQL}, {v1_sql('priced')} SELECT series_id, trade_date, price, has_real_price, "Day", "Month", "Year",
       "Weekday", "IS_WORKDAY", {rounds(V1_DOUBLES, 5, RAW_PRICES)} FROM v1""",
    "feature_frame_v2": f"""WITH {PRICED_SQL}, {v2_sql('priced')} SELECT series_id, trade_date, {rounds(V2_DOUBLES, 5, RAW_PRICES)},
       {', '.join(CALENDAR_V2)} FROM v2""",
    "exog_returns": f"""WITH {MARKET_SQL} SELECT series_id, trade_date, round(coalesce((price - lag(price) OVER o)
       / CASE WHEN lag(price) OVER o = 0 THEN 1.0 ELSE lag(price) OVER o END, 0), 6) AS price_move FROM market {O}""",
    "events_rolling_mean": f"""WITH {EVENTS_SQL} SELECT event_type, event_id, round(avg(price) OVER (PARTITION BY event_type
       ORDER BY ts, event_id ROWS 29 PRECEDING), 4) AS price_rolling_mean_30d FROM ev""",
    "events_pct_change": f"""WITH {EVENTS_SQL} SELECT event_type, event_id,
       round(price / nullif(lag(price) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0) - 1, 4) AS price_return FROM ev""",
    "lines_features": f"""WITH {LINES_SQL} SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(avg(price) OVER f, 6) AS mean29,
       lag(price, 9) OVER o AS lag9, lead(price, 3) OVER o AS ahead
FROM lines WINDOW o AS ({LINES_OVER}), f AS ({LINES_OVER} ROWS 28 PRECEDING)""",
    "lines_forward_fill": f"""WITH {LINES_SQL}, g AS (SELECT * REPLACE (CASE WHEN l_discount > 0.045 THEN price END AS price) FROM lines)
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(last_value(price IGNORE NULLS) OVER ({LINES_OVER} ROWS UNBOUNDED PRECEDING),
       first_value(price IGNORE NULLS) OVER ({LINES_OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM g""",
    "lines_split": f"""WITH {LINES_SQL}, p AS (SELECT *, row_number() OVER ({LINES_OVER}) - 1 AS idx, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lines)
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, idx, CASE WHEN idx < n - floor(n * 0.15) - floor(n * 0.15) THEN 'train'
            WHEN idx < n - floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM p""",
    "forward_return": f"WITH {PRICED_SQL} SELECT series_id, trade_date, round(lead(price) OVER o / price - 1, 6) AS ret_fwd FROM priced {O}",
    "forward_return_horizon": f"""WITH {PRICED_SQL} SELECT series_id, trade_date,
       round(lead(price, 5) OVER o / lead(price, 4) OVER o - 1, 6) AS ret_fwd FROM priced {O}""",
    "target_sign": f"""WITH {PRICED_SQL}, f AS (SELECT *, lead(price) OVER o / price - 1 AS r FROM priced {O})
SELECT series_id, trade_date, CASE WHEN r > 0 THEN 1 WHEN r IS NOT NULL THEN 0 END AS y_target FROM f""",
    "target_3class": f"""WITH {PRICED_SQL}, f AS (SELECT *, lead(price) OVER o / price - 1 AS r FROM priced {O})
SELECT series_id, trade_date, CASE WHEN r > 0.02 THEN 2 WHEN r < -0.02 THEN 0 WHEN r IS NOT NULL THEN 1 END AS y_target FROM f""",
    "target_price": f"WITH {PRICED_SQL} SELECT series_id, trade_date, round(lead(price) OVER o / price - 1, 6) AS y_target FROM priced {O}",
    "target_volatility": f"""WITH {PRICED_SQL} SELECT series_id, trade_date, round(abs(lead(price) OVER o / price - 1), 6) AS y_target
FROM priced {O}""",
    "drop_unlabelled": f"{LAB} SELECT series_id, trade_date, round(ret_fwd, 6) AS y_target FROM lab",
    "split_chronological": f"WITH {SPLIT_SQL} SELECT series_id, trade_date, idx, split FROM split",
    "split_chronological_by_date": f"""WITH {PRICED_SQL}, total AS (SELECT count(*) AS n FROM priced),
seen AS (SELECT trade_date, sum(count(*)) OVER (ORDER BY trade_date) AS c FROM priced GROUP BY trade_date),
bounds AS (SELECT min(trade_date) FILTER (c > n - floor(n * 0.15) - floor(n * 0.15)) AS v,
                  min(trade_date) FILTER (c > n - floor(n * 0.15)) AS t FROM seen, total)
SELECT series_id, trade_date, row_number() OVER o - 1 AS idx,
       CASE WHEN trade_date < v THEN 'train' WHEN trade_date < t THEN 'val' ELSE 'test' END AS split FROM priced, bounds {O}""",
    "split_rolling_window": f"""WITH {PRICED_SQL},
placed AS (SELECT *, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM priced {O})
SELECT series_id, trade_date, idx, CASE WHEN idx < floor(n * 0.5) THEN 'train' WHEN idx < floor(n * 0.5) + floor(n * 0.15) THEN 'val'
       WHEN idx < floor(n * 0.5) + 2 * floor(n * 0.15) THEN 'test' END AS split FROM placed""",
    "time_series_folds": f"""WITH {PRICED_SQL},
placed AS (SELECT *, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM priced {O})
SELECT series_id, trade_date, idx, CASE WHEN idx < n - 5 * (n // 6) THEN 0 ELSE (idx - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold FROM placed""",
    "split_counts": f"WITH {SPLIT_SQL} SELECT series_id, split, count(*) AS n FROM split GROUP BY series_id, split",
    "union_splits": f"""WITH {SPLIT_SQL} SELECT series_id, trade_date, split FROM split WHERE split = 'train'
UNION ALL SELECT series_id, trade_date, split FROM split WHERE split = 'val'""",
    "standard_scale": _scaler_sql("standard"),
    "minmax_scale": _scaler_sql("minmax"),
    "scalar_broadcast": f"""WITH {SPLIT_SQL}, one AS (SELECT {', '.join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in CORE)} FROM split WHERE split = 'train')
SELECT series_id, trade_date, {', '.join(f"round(({c} - {c}_m) / {c}_s, 4) AS {c}" for c in CORE)} FROM split, one""",
    "balance_downsample": f"""{LAB}, ranked AS (SELECT *, row_number() OVER (PARTITION BY y_target
       ORDER BY md5('42:' || series_id || ':' || trade_date), series_id, trade_date) AS k FROM lab),
smallest AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM lab GROUP BY y_target))
SELECT series_id, trade_date, y_target FROM ranked, smallest WHERE k <= n""",
    "sequences_next": _sequence_sql("14 PRECEDING", "1 PRECEDING"),
    "sequences_same": _sequence_sql("13 PRECEDING", "CURRENT ROW"),
    "sequence_last_step": f"""WITH {SPLIT_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY series_id, split ORDER BY trade_date ROWS 13 PRECEDING) AS k FROM split)
SELECT series_id, trade_date, [price, volume] AS features FROM c WHERE k = 14""",
    "make_dataset": _dataset_sql(),
    "make_dataset_v1": f"""WITH {V1_INPUT_SQL}, {v1_sql('repaired', 'has_real_price')},
real AS (SELECT *, lead(price) OVER o / price - 1 AS ret_fwd FROM v1 WHERE has_real_price {O}),
known AS (SELECT *, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM real WHERE ret_fwd IS NOT NULL {O})
SELECT series_id, trade_date, CASE WHEN idx < n - floor(n * 0.15) - floor(n * 0.15) THEN 'train'
            WHEN idx < n - floor(n * 0.15) THEN 'val' ELSE 'test' END AS split,
       {rounds(['ret_fwd', 'price', 'price_return', 'volatility_30d', 'trend_slope'], 4, ('price',))} FROM known""",
    "price_summary": f"""WITH {MARKET_SQL} SELECT series_id, count(*) AS rows, date_diff('day', min(trade_date), max(trade_date)) AS days,
       round(avg(price), 6) AS avg_price, round(min(price), 6) AS min_price, round(max(price), 6) AS max_price,
       round(stddev_samp(price), 6) AS std_price, round(stddev_samp(price) / avg(price) * 100, 6) AS volatility_pct FROM market GROUP BY series_id""",
    "class_distribution": f"""{LAB} SELECT series_id, y_target, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY series_id), 6) AS pct FROM lab GROUP BY series_id, y_target""",
    "class_balance_ratio": f"""{LAB}, c AS (SELECT series_id, y_target, count(*) AS n FROM lab GROUP BY ALL)
SELECT series_id, round(min(n) / max(n), 6) AS balance_ratio, min(n) / max(n) < 0.8 AS imbalanced FROM c GROUP BY series_id""",
    "zero_change_share": f"""WITH {MARKET_SQL}, c AS (SELECT series_id, abs(price - lag(price) OVER o) AS change FROM market WHERE price IS NOT NULL {O})
SELECT series_id, count(*) AS records, count(change) AS changes, count(*) FILTER (change < {FLAT}) AS zero_changes,
       round(count(*) FILTER (change < {FLAT}) * 100.0 / count(change), 6) AS zero_pct,
       count(*) FILTER (change < {FLAT}) * 100.0 / count(change) > 10 AS suspicious FROM c GROUP BY series_id""",
    "target_summary": f"""{LAB} SELECT series_id, round(avg(ret_fwd), 6) AS mean, round(stddev_pop(ret_fwd), 6) AS std,
       round(min(ret_fwd), 6) AS min, round(max(ret_fwd), 6) AS max FROM lab GROUP BY series_id""",
    "feature_target_corr": LAB + " UNION ALL ".join(
        f" SELECT '{c}' AS feature, round(abs(corr({c}, ret_fwd)), 6) AS abs_corr FROM lab" for c in CORE),
    "topk_features": LAB + ", c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(corr({c}, ret_fwd)) AS r FROM lab" for c in CORE)
        + ") SELECT feature, round(r, 6) AS abs_corr FROM c ORDER BY r DESC, feature LIMIT 3",
    "class_weights": f"""{LAB}, c AS (SELECT series_id, count(*) FILTER (y_target = 0) AS negatives, count(*) FILTER (y_target = 1) AS positives FROM lab GROUP BY series_id)
SELECT *, round(least(10.0, greatest(1.0, negatives / positives)), 6) AS pos_weight FROM c""",
    "sort_by_date": f"WITH {MARKET_SQL} SELECT series_id, trade_date, price FROM market ORDER BY trade_date, series_id",
    "head_preview": f"WITH {MARKET_SQL} SELECT * FROM market ORDER BY trade_date, series_id LIMIT 5",
}
