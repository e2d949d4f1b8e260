"""Regressions from sums against numpy on the rows themselves."""

import numpy as np
import pytest
from conftest import rows

from gridtide.models.arx import (Arx, arima_order_select, arx_fit, arx_forecast, arx_order_select, detect_differences, refit_range_join, rolling_arx_forecast,
                                 seasonal_critical, stationarity_test, with_lags, with_shocks)
from gridtide.operators.features import exog_returns
from gridtide.operators.targets import split_chronological
from gridtide.plans.timeline import SeriesOrder
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def moves(priced):
    rows_ = exog_returns(priced.filter("trade_date < DATE '1998-01-01'"))
    return split_chronological(rows_).withColumn("load", F.col("pjm_load") / 10).cache()


def series(moves, key="A"):
    got = moves.filter(F.col("series_id") == key).orderBy("idx").collect()
    return np.array([r["price_move"] for r in got]), np.array([r["load"] for r in got]), [r["split"] for r in got]


def design(y, x, lags, start):
    m = max(lags)
    return np.array([[1.0, *(y[t - k] for k in lags), x[t]] for t in range(max(start, m), len(y))])


def test_fit_equals_numpy(moves):
    model = Arx(2, 1, 7, 0, ("load",))
    coef = arx_fit(with_lags(moves, model), model).filter("series_id = 'A'").first()["coef"]
    y, x, _ = series(moves)
    expected = np.linalg.lstsq(design(y, x, [1, 2, 7], 0), y[7:], rcond=None)[0]
    assert coef == pytest.approx(expected, rel=1e-8, abs=1e-10)


@pytest.mark.parametrize("d", [0, 1])
def test_forecast_equals_a_step_by_step_loop(moves, d):
    model = Arx(2, 1, 7, d, ("load",))
    got = arx_forecast(moves, model).filter("series_id = 'A'")
    found = {r["idx"]: r["y_pred"] for r in got.collect()}
    y, x, split = series(moves)
    for target, seen in (("val", ("train",)), ("test", ("train", "val"))):
        n = sum(s in seen for s in split)
        h = sum(s == target for s in split)
        work = np.diff(y, n=d) if d else y
        lags, off = [1, 2, 7], d
        X = np.array([[1.0, *(work[t - k] for k in lags), x[t + off]] for t in range(7, n - off)])
        b = np.linalg.lstsq(X, work[7 : n - off], rcond=None)[0]
        past, level = list(work[: n - off]), y[n - 1]
        for t in range(n, n + h):
            step = b[0] + sum(b[1 + i] * past[-k] for i, k in enumerate(lags)) + b[4] * x[t]
            past.append(step)
            level = level + step if d else step
            assert found[t] == pytest.approx(level, rel=1e-6, abs=1e-8)


def test_a_long_horizon_in_stretches_is_the_same(moves):
    model = Arx(2, 1, 7, 1, ("load",))
    plain = rows(arx_forecast(moves, model).select("series_id", "idx", "y_pred"), places=7)
    parts = rows(arx_forecast(moves, model, stretch=9, order=SeriesOrder(block_rows=64)).select("series_id", "idx", "y_pred"), places=7)
    assert len(plain) == len(parts)
    assert np.allclose([r[2] for r in plain], [r[2] for r in parts], atol=1e-6)


def test_rolling_refits_equal_a_loop(moves):
    model = Arx(2, 0, 7, 0, ("load",))
    got = {r["idx"]: r["y_pred"] for r in rolling_arx_forecast(moves, model, refit_every=20, max_history=100)
           .filter("series_id = 'A'").collect()}
    y, x, _ = series(moves)
    X = {t: np.array([1.0, y[t - 1], y[t - 2], x[t]]) for t in range(2, len(y))}
    for cut in range(20, len(y), 20):
        past = [t for t in range(max(2, cut - 100), cut)]
        b = np.linalg.lstsq(np.array([X[t] for t in past]), y[past], rcond=None)[0]
        for t in range(cut, min(cut + 20, len(y))):
            assert got[t] == pytest.approx(float(X[t] @ b), rel=1e-6, abs=1e-9)
    assert got[0] is None
    blocked = rolling_arx_forecast(moves, model, refit_every=20, max_history=100, order=SeriesOrder(block_rows=10))
    again = {r["idx"]: r["y_pred"] for r in blocked.filter("series_id = 'A'").collect()}
    assert all(again[t] == pytest.approx(v, rel=1e-9, abs=1e-12) if v is not None else again[t] is None for t, v in got.items())


def test_order_selection_picks_the_lowest_aic(moves):
    got = arx_order_select(moves, max_p=3, max_P=1).filter("series_id = 'A'").first()
    y, _, _ = series(moves)
    best = None
    for p in range(4):
        for big in range(2):
            lags = [*range(1, p + 1), *([7] if big else [])]
            X = np.array([[1.0, *(y[t - k] for k in lags)] for t in range(7, len(y))])
            b = np.linalg.lstsq(X, y[7:], rcond=None)[0]
            n = len(y) - 7
            aic = n * np.log(((y[7:] - X @ b) ** 2).sum() / n) + 2 * X.shape[1]
            if best is None or aic < best[0] - 1e-9:
                best = (aic, p, big)
    assert (got["p"], got["seasonal_p"]) == best[1:]
    assert got["aic"] == pytest.approx(best[0], rel=1e-8)


def test_stationarity_of_noise_and_of_a_walk(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=600)
    data = [(k, i, float(v)) for k, s in (("noise", noise), ("walk", np.cumsum(noise))) for i, v in enumerate(s)]
    df = spark.createDataFrame(data, "series_id string, i int, v double").withColumn(
        "trade_date", F.date_from_unix_date("i"))
    got = {r["series_id"]: r for r in stationarity_test(df, "v", max_lag=4).collect()}
    assert got["noise"]["is_stationary"] and not got["walk"]["is_stationary"]
    assert got["noise"]["critical"] == pytest.approx(-2.866, abs=2e-3)


def test_order_names_the_lags_it_uses_when_seasons_are_short(moves):
    """With a season of two rows, lag 2 is a near lag as well as a seasonal one."""
    got = arx_order_select(moves, max_p=3, max_P=1, s=2).collect()
    assert got and all(r["seasonal_p"] == 0 or r["p"] < 2 for r in got)


def test_result_of_order_selection_can_be_written(moves, tmp_path):
    path = str(tmp_path / "orders")
    arx_order_select(moves, max_p=2, max_P=1).write.parquet(path)
    assert moves.sparkSession.read.parquet(path).count() == moves.select("series_id").distinct().count()


def test_stationarity_equals_a_loop(moves):
    """Lags by AIC on the common sample, then the fit on all rows that the chosen lags leave."""
    got = stationarity_test(moves).filter("series_id = 'A'").first()
    y, _, _ = series(moves)
    n, step = len(y), np.diff(y)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)

    def fit(lags, start):
        X = np.array([[1.0, y[t], *(step[t - k] for k in range(1, lags + 1))] for t in range(start, len(step))])
        b = np.linalg.lstsq(X, step[start:], rcond=None)[0]
        sse = ((step[start:] - X @ b) ** 2).sum()
        return len(X) * np.log(sse / len(X)) + 2 * X.shape[1], b[1] / np.sqrt(sse / (len(X) - X.shape[1]) * np.linalg.inv(X.T @ X)[1, 1]), len(X)

    best = min(range(most + 1), key=lambda k: fit(k, most)[0])
    _, t, rows_ = fit(best, best)
    assert (got["lags"], got["n"]) == (best, rows_) and got["statistic"] == pytest.approx(t, rel=1e-6)
    assert 0 <= got["p_value"] <= 1 and (got["p_value"] < 0.05) == got["is_stationary"]


def test_range_join_counts(moves):
    got = refit_range_join(moves, {"n": F.count(F.lit(1)), "lo": F.min("idx")}, {"n": F.sum("n"), "lo": F.min("lo")},
                           refit_every=10, max_history=50).filter("series_id = 'A'").collect()
    assert all(r["n"] == min(50, r["cut"]) and r["lo"] == max(0, r["cut"] - 50) for r in got)


def daily(spark, **series):
    import datetime

    rows_ = [(k, datetime.date(2000, 1, 1) + datetime.timedelta(days=i), float(v)) for k, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows_, "series_id string, trade_date date, v double")


def shocks_of(y, x, lags, shock_lags, long):
    """Residuals of the long autoregression, then the design of the second stage and its targets, by numpy."""
    first = np.array([[1.0, *(y[t - k] for k in range(1, long + 1)), *x[t]] for t in range(long, len(y))])
    e = np.full(len(y), np.nan)
    e[long:] = y[long:] - first @ np.linalg.lstsq(first, y[long:], rcond=None)[0]
    start = long + max(shock_lags)
    design_ = np.array([[1.0, *(y[t - k] for k in lags), *x[t], *(e[t - k] for k in shock_lags)] for t in range(start, len(y))])
    return e, design_, y[start:]


def test_two_stages_equal_numpy_and_find_planted_terms(spark):
    rng = np.random.default_rng(3)
    e = rng.standard_normal(4000)
    y = np.zeros(4000)
    for t in range(8, 4000):
        y[t] = 0.5 + 0.6 * y[t - 1] + e[t] + 0.4 * e[t - 1] + 0.3 * e[t - 7]
    df = daily(spark, a=y, b=y[::-1])
    model = Arx(1, 0, 7, 0, (), "v", 1, 1)
    coef = arx_fit(with_shocks(with_lags(df, model), model), model).filter("series_id = 'a'").first()["coef"]
    _, design_, target = shocks_of(y, np.zeros((4000, 0)), [1], [1, 7], 14)
    assert coef == pytest.approx(np.linalg.lstsq(design_, target, rcond=None)[0], rel=1e-7, abs=1e-9)
    assert model.names() == ["const", "lag1", "shock1", "shock7"] and coef == pytest.approx([0.5, 0.6, 0.4, 0.3], abs=0.06)


@pytest.mark.parametrize("d, D", [(0, 0), (1, 1)])
def test_moving_average_forecast_equals_a_loop(moves, d, D):
    model = Arx(2, 0, 7, d, ("load",), q=1, Q=1, D=D)
    found = {r["idx"]: r["y_pred"] for r in arx_forecast(moves, model).filter("series_id = 'A'").collect()}
    blocked = {r["idx"]: r["y_pred"] for r in arx_forecast(moves, model, stretch=9, order=SeriesOrder(block_rows=64)).filter("series_id = 'A'").collect()}
    y, x, split = series(moves)
    lost = d + 7 * D
    for target, seen in (("val", ("train",)), ("test", ("train", "val"))):
        n, h = sum(s in seen for s in split), sum(s == target for s in split)
        work = np.diff(y[:n], n=d) if d else y[:n]
        work = work[7:] - work[:-7] if D else work
        e, design_, aim = shocks_of(work, x[lost:n, None], [1, 2], [1, 7], 14)
        b = np.linalg.lstsq(design_, aim, rcond=None)[0]
        past, level, shocks = list(work), list(y[:n]), list(e)
        for t in range(n, n + h):
            step = b[0] + b[1] * past[-1] + b[2] * past[-2] + b[3] * x[t] + b[4] * shocks[-1] + b[5] * shocks[-7]
            past.append(step)
            shocks.append(0.0)
            level.append(step + (level[-1] + level[-7] - level[-8] if d else 0.0))
            assert found[t] == pytest.approx(level[-1], rel=1e-5, abs=1e-7) == blocked[t]


@pytest.mark.parametrize("d, D", [(2, 0), (1, 1)])
def test_rolling_with_differences_and_a_history_of_any_length(moves, d, D):
    model = Arx(1, 0, 7, d, (), D=D)
    y = series(moves)[0]
    got = {r["idx"]: r["y_pred"] for r in rolling_arx_forecast(moves, model, refit_every=20, max_history=73).filter("series_id = 'A' AND y_pred IS NOT NULL").collect()}
    blocked = rolling_arx_forecast(moves, model, refit_every=20, max_history=73, order=SeriesOrder(block_rows=10))
    assert rows(blocked.select("series_id", "idx", "y_pred")) == rows(rolling_arx_forecast(moves, model, refit_every=20, max_history=73).select("series_id", "idx", "y_pred"))
    work = np.full(len(y), np.nan)
    kept = np.diff(y, n=d)
    kept = kept[7:] - kept[:-7] if D else kept
    lost = d + 7 * D
    work[lost:] = kept
    for t in (100, 119, 120, 305):
        end = t // 20 * 20
        at = [u for u in range(max(0, end - 73), end) if u > lost]
        X = np.array([[1.0, work[u - 1]] for u in at])
        b = np.linalg.lstsq(X, work[at], rcond=None)[0]
        assert got[t] == pytest.approx(b[0] + b[1] * work[t - 1] + y[t] - work[t], rel=1e-6, abs=1e-8)


def test_refit_ranges_of_any_length(moves):
    stats = {"n": F.count(F.lit(1)), "total": F.sum("idx")}
    for history in (73, 7, 20):
        got = refit_range_join(moves, stats, {"n": F.sum("n"), "total": F.sum("total")}, refit_every=20, max_history=history).filter("series_id = 'A'").collect()
        assert len(got) > 10
        for r in got:
            own = range(max(0, r["cut"] - history), r["cut"])
            assert (r["n"], r["total"]) == (len(own), sum(own))


def test_rolling_shocks_are_what_the_first_stage_missed(moves):
    model = Arx(1, 0, 2, 0, (), q=1)
    first = {r["idx"]: r for r in rolling_arx_forecast(moves, model.first_stage(), refit_every=20, max_history=100).filter("series_id = 'A'").collect()}
    e = {i: r["price_move"] - r["y_pred"] for i, r in first.items() if r["y_pred"] is not None}
    y = series(moves)[0]
    got = {r["idx"]: r["y_pred"] for r in rolling_arx_forecast(moves, model, refit_every=20, max_history=100).filter("series_id = 'A'").collect()}
    for t in (200, 219, 301):
        end = t // 20 * 20
        at = [u for u in range(end - 100, end) if u - 1 in e]
        b = np.linalg.lstsq(np.array([[1.0, y[u - 1], e[u - 1]] for u in at]), y[at], rcond=None)[0]
        assert got[t] == pytest.approx(b @ [1.0, y[t - 1], e[t - 1]], rel=1e-6, abs=1e-8)


def test_planted_differences_are_found(spark):
    rng = np.random.default_rng(12)
    noise = rng.standard_normal((5, 700))
    season = np.cumsum(noise[2].reshape(100, 7), axis=0).reshape(-1)
    ar = np.zeros(700)
    for t in range(1, 700):
        ar[t] = 0.7 * ar[t - 1] + noise[0, t]
    df = daily(spark, stationary=ar, walk=np.cumsum(noise[1]), season=season, both=np.cumsum(np.cumsum(noise[3].reshape(100, 7), axis=0).reshape(-1)),
               twice=np.cumsum(np.cumsum(noise[4])))
    assert seasonal_critical(7) < -1
    got = {r["series_id"]: (r["d"], r["seasonal_d"]) for r in detect_differences(df, "v").collect()}
    assert got == {"stationary": (0, 0), "walk": (1, 0), "season": (0, 1), "both": (1, 1), "twice": (2, 0)}


def test_orders_of_planted_series(spark):
    rng = np.random.default_rng(4)
    e = rng.standard_normal(3000)
    ma = e[7:] + 0.6 * e[6:-1] + 0.5 * e[:-7]
    walk = np.cumsum(ma)
    ar = np.zeros(3000)
    for t in range(2, 3000):
        ar[t] = 0.5 * ar[t - 1] - 0.4 * ar[t - 2] + e[t]
    df = daily(spark, walk=walk, ar=ar)
    got = {r["series_id"]: r for r in arima_order_select(df, max_p=2, max_q=2, max_P=1, max_Q=1, y="v").collect()}
    assert (got["walk"]["d"], got["walk"]["seasonal_d"]) == (1, 0) and got["walk"]["q"] >= 1 and got["walk"]["seasonal_q"] == 1
    assert (got["ar"]["d"], got["ar"]["p"]) == (0, 2)
    given = df.select("series_id").distinct().withColumns({"d": F.lit(0), "seasonal_d": F.lit(1)})
    assert {r["seasonal_d"] for r in arima_order_select(df, max_p=1, max_q=0, max_P=0, max_Q=0, y="v", differences=given).collect()} == {1}


def test_stationarity_with_gaps_equals_a_loop(spark):
    """Missing values cut a series into runs; each has ends of its own."""
    rng = np.random.default_rng(9)
    y = np.zeros(400)
    for t in range(2, 400):
        y[t] = 0.6 * y[t - 1] + 0.2 * y[t - 2] + rng.standard_normal()
    gone = {50, 51, 130, 133, 260}
    df = daily(spark, a=y, b=y[:40]).withColumn("v", F.when((F.col("series_id") == "a") & F.dayofyear("trade_date").isin(sorted(gone)) & (F.year("trade_date") == 2000), None).otherwise(F.col("v")))
    for blocked in (SeriesOrder(), SeriesOrder(block_rows=32)):
        got = {r["series_id"]: r for r in stationarity_test(df, "v", max_lag=6, order=blocked).collect()}
        values = np.array([np.nan if i + 1 in gone else v for i, v in enumerate(y)])
        step = np.concatenate(([np.nan], np.diff(values)))
        rows_ = [[1.0, values[t - 1], *(step[t - k] for k in range(1, 7)), step[t]] for t in range(7, 400)]
        full = np.array([r for r in rows_ if not np.isnan(r).any()])
        aic = []
        for k in range(7):
            X, target = full[:, : 2 + k], full[:, -1]
            sse = ((target - X @ np.linalg.lstsq(X, target, rcond=None)[0]) ** 2).sum()
            aic.append(len(full) * np.log(sse / len(full)) + 2 * (k + 2))
        k = int(np.argmin(aic))
        again = np.array([r for r in ([1.0, values[t - 1], *(step[t - j] for j in range(1, k + 1)), step[t]] for t in range(k + 1, 400)) if not np.isnan(r).any()])
        X, target = again[:, :-1], again[:, -1]
        b = np.linalg.lstsq(X, target, rcond=None)[0]
        spread = np.sqrt(((target - X @ b) ** 2).sum() / (len(X) - k - 2) * np.linalg.inv(X.T @ X)[1, 1])
        assert (got["a"]["lags"], got["a"]["n"]) == (k, len(X)) and got["a"]["statistic"] == pytest.approx(b[1] / spread, rel=1e-7)
        assert got["b"]["lags"] is not None


def test_plan_of_the_stationarity_test_is_linear_in_the_lags(moves):
    from gridtide.models.arx import _unit_root_fits

    def size(k):
        rows_ = moves.select("series_id", "trade_date", "idx", F.lit(1.0).alias("_before"), F.lit(1.0).alias("_step"), *(F.lit(1.0).alias(f"_step{i}") for i in range(1, k + 1)))
        fits = _unit_root_fits(rows_, moves.select("series_id", F.lit(k).alias("_lags")).distinct(), k, False, SeriesOrder())
        return fits._jdf.queryExecution().analyzed().toString().count("sum(")

    assert size(40) < 2.2 * size(20)


def test_equal_values_have_no_statistic(spark):
    got = stationarity_test(daily(spark, a=[1.0] * 60, b=list(range(60))), "v", max_lag=2).collect()
    assert all(r["statistic"] is None or np.isfinite(r["statistic"]) for r in got)
