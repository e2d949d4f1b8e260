"""Autoregressive moving-average forecasts with outside regressors, fitted for every series at once.

Moving-average terms are fitted in two stages (Hannan and Rissanen): the residuals of a long autoregression
stand for the shocks, and their lags are regressors of the second. Both stages are solved from summed cross
products.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cache, reduce
from itertools import product
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gridtide.models.leastsquares import NESTED_TYPE, complete, cross_sums, fit_summed, nested_fit, normal_equations, predict, shifted_products
from gridtide.plans.attach import attach, join_on
from gridtide.plans.timeline import BLOCK_ROWS, DAILY, SeriesFrame, SeriesOrder, windowed
from gridtide.session import cut

# MacKinnon (2010) response surface of the Dickey-Fuller test with a constant.
CRITICAL = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040),
            0.10: (-2.56677, -1.5384, -2.809, 0.0)}

# MacKinnon (1994), p-value of the test with a constant: lowest, middle and highest statistic, polynomials below and above the middle.
P_RANGE = (-18.83, -1.61, 2.74)
P_LOW = (2.1659, 1.4412, 0.038269)
P_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


@dataclass(frozen=True)
class Arx:
    """p lags, P seasonal lags of period s, d differences, outside regressors of the same row; q and Q lagged shocks alike, D seasonal differences."""

    p: int = 2
    P: int = 1
    s: int = 7
    d: int = 0
    exog: tuple[str, ...] = ()
    y: str = "price_move"
    q: int = 0
    Q: int = 0
    D: int = 0

    def lags(self) -> list[int]:
        seasonal = [self.s * i for i in range(1, self.P + 1)]
        return sorted({*range(1, self.p + 1), *seasonal})

    def shock_lags(self) -> list[int]:
        return sorted({*range(1, self.q + 1), *(self.s * i for i in range(1, self.Q + 1))})

    def reach(self) -> int:
        return max(self.lags(), default=0) + self.d + self.s * self.D

    def first_stage(self) -> Arx:
        """The autoregression whose residuals stand for the shocks: one season longer than any lag."""
        longest = max([*self.lags(), *self.shock_lags()], default=0) + self.s
        return replace(self, p=longest, P=0, q=0, Q=0)

    def regressors(self) -> list[str]:
        return ["1D", *(f"_lag{k}" for k in self.lags()), *(f"CAST(`{c}` AS DOUBLE)" for c in self.exog), *(f"_shock{k}" for k in self.shock_lags())]

    def names(self) -> list[str]:
        return ["const", *(f"lag{k}" for k in self.lags()), *self.exog, *(f"shock{k}" for k in self.shock_lags())]


def with_lags(df: DataFrame, model: Arx, order: SeriesOrder = DAILY) -> DataFrame:
    """Add the position `idx`, the differenced value `_y` and its lags, with shocks also those of the first stage."""
    widest = model.first_stage() if model.shock_lags() else model
    steps = [lambda w: {"_y": F.col(model.y)}]
    steps += [lambda w: {"_y": F.col("_y") - F.lag("_y").over(w)}] * model.d
    steps += [lambda w: {"_y": F.col("_y") - F.lag("_y", model.s).over(w)}] * model.D
    steps.append(lambda w: {f"_lag{k}": F.lag("_y", k).over(w) for k in widest.lags()})
    frame = SeriesFrame.open(df, order, lookback=widest.reach())
    frame = frame if "idx" in df.columns else frame.index("idx")
    for step in steps:
        frame = frame.with_columns(step)
    return frame.close()


def with_shocks(lagged: DataFrame, model: Arx, order: SeriesOrder = DAILY) -> DataFrame:
    """Add `_shock`, the residual of the first stage fitted to these rows, and its lags; rows that the lags don't reach have none."""
    if not model.shock_lags():
        return lagged
    long, keys = model.first_stage(), list(order.keys)
    known = attach(lagged, arx_fit(lagged, long, keys).select(*keys, F.col("coef").alias("_long")), keys)
    told = order.cut(known.withColumn("_shock", F.col("_y") - predict("_long", long.regressors())).drop("_long"))
    lags = model.shock_lags()
    return windowed(told, lambda w: {f"_shock{k}": F.lag("_shock", k).over(w) for k in lags}, order=order, lookback=lags[-1])


def arx_fit(lagged: DataFrame, model: Arx, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per series: coefficients in the order of `model.names()`, SSE, AIC, BIC."""
    xs = model.regressors()
    return fit_summed(normal_equations(lagged, xs, "_y", by), len(xs), by)


def arx_order_select(df: DataFrame, *, max_p: int = 5, max_P: int = 2, s: int = 7, d: int = 0, exog: Sequence[str] = (),
                     y: str = "price_move", order: SeriesOrder = DAILY) -> DataFrame:
    """The orders `p` and `seasonal_p` with the lowest AIC for every series.

    All candidates are solved from the sums of the largest one, so they share one pass and one sample.
    Of orders with the same lags the one with fewer seasonal lags is named.
    """
    widest = Arx(max_p, max_P, s, d, tuple(exog), y)
    names, lags = widest.names(), widest.lags()
    named = {}
    for big in range(max_P + 1):
        for p in range(max_p + 1):
            wanted = {*range(1, p + 1), *(s * i for i in range(1, big + 1))}
            at = (0, *(1 + lags.index(k) for k in sorted(wanted)), *range(1 + len(lags), len(names)))
            named.setdefault(at, (p, big))
    subsets = sorted(named, key=len)
    lagged = with_lags(df, widest, order)
    xs = widest.regressors()
    fits = fit_summed(normal_equations(lagged, xs, "_y", order.keys), len(xs), order.keys, subsets)
    orders = F.create_map(*(F.lit(v) for at, (p, big) in named.items() for v in (",".join(map(str, at)), f"{p},{big}")))
    chosen = F.split(orders[F.array_join("used", ",")], ",")
    return fits.select(*order.keys, chosen[0].cast("int").alias("p"), chosen[1].cast("int").alias("seasonal_p"), F.lit(d).alias("d"),
                       "n", "sse", "aic", "bic", "coef")


def _choices(widest: Arx) -> dict[tuple[int, ...], tuple[int, int, int, int]]:
    """The regressors of `widest` that each order (p, P, q, Q) has; of orders with the same ones, that with the fewest seasonal terms."""
    names = widest.names()
    out: dict[tuple[int, ...], tuple[int, int, int, int]] = {}
    for P, Q, p, q in product(range(widest.P + 1), range(widest.Q + 1), range(widest.p + 1), range(widest.q + 1)):
        own = replace(widest, p=p, P=P, q=q, Q=Q)
        out.setdefault(tuple(sorted(names.index(n) for n in own.names())), (p, P, q, Q))
    return out


@cache
def seasonal_critical(s: int, level: float = 0.05, years: int = 100, draws: int = 4000) -> float:
    """The value that the statistic of `seasonal_unit_root` falls below with probability `level` if there is a seasonal unit root.

    Taken from simulated seasonal random walks, always the same ones.
    """
    rng, found = np.random.default_rng(7), []
    for _ in range(0, draws, 500):
        walk = np.cumsum(rng.standard_normal((500, years, s)), axis=1)
        before, step = walk[:, :-1].reshape(500, -1), np.diff(walk, axis=1).reshape(500, -1)
        b, d = before - before.mean(axis=1, keepdims=True), step - step.mean(axis=1, keepdims=True)
        sxx, sxy, syy = (b * b).sum(axis=1), (b * d).sum(axis=1), (d * d).sum(axis=1)
        slope = sxy / sxx
        found.append(slope / np.sqrt((syy - slope * sxy) / (b.shape[1] - 2) / sxx))
    return round(float(np.quantile(np.concatenate(found), level)), 2)


def seasonal_unit_root(df: DataFrame, y: str, s: int, order: SeriesOrder = DAILY) -> DataFrame:
    """Per series whether `y` keeps its seasonal level forever: the t value of the regression of the seasonal step on the value a season before."""
    keys = list(order.keys)
    rows = windowed(df, lambda w: {"_before": F.lag(y, s).over(w)}, order=order, lookback=s).withColumn("_step", F.col(y) - F.col("_before"))
    fits = fit_summed(normal_equations(rows, ["1D", "_before"], "_step", keys), 2, keys, first=1)
    return fits.select(*keys, F.col("t_first").alias("statistic"), F.coalesce(F.col("t_first") >= seasonal_critical(s), F.lit(False)).alias("seasonal"))


def detect_differences(df: DataFrame, y: str = "price_move", *, s: int = 7, max_d: int = 2, order: SeriesOrder = DAILY) -> DataFrame:
    """d and seasonal_d of every series: differences until the unit-root test rejects, and a seasonal one if a seasonal unit root is left.

    A seasonal walk also has a plain unit root, so the seasonal test looks at the steps of a series that has one; the plain
    differences of a series with a seasonal one are counted after that.
    """
    keys = list(order.keys)
    df = order.cut(df.select(*order.columns(), y))

    def differenced(series: DataFrame, d: int, D: int) -> DataFrame:
        rows = join_on(df, series.select(*keys).withColumn("_wanted", F.lit(True)), keys).drop("_wanted")
        return order.cut(with_lags(rows, Arx(0, 0, s, d, (), y, D=D), order).select(*order.columns(), "_y").filter("_y IS NOT NULL"))

    def walks(series: DataFrame, d: int, D: int) -> DataFrame:
        tested = stationarity_test(differenced(series, d, D), "_y", order=order)
        return cut(tested.select(*keys, (~F.coalesce("is_stationary", F.lit(True))).alias("walks")))

    every = df.select(*keys).distinct()
    plain = walks(every, 0, 0)
    left, out = [], []
    for flag in (False, True):
        some = plain.filter(F.col("walks") == flag).select(*keys)
        if not some.isEmpty():
            left.append(seasonal_unit_root(differenced(some, int(flag), 0), "_y", s, order).withColumn("walks", F.lit(flag)))
    if not left:
        return every.select(*keys, F.lit(0).alias("d"), F.lit(0).alias("seasonal_d"))
    seasons = cut(reduce(DataFrame.unionByName, left))
    for D in (0, 1):
        open_ = seasons.filter(F.col("seasonal") == bool(D)).select(*keys, "walks")
        for d in range(max_d + 1):
            if open_.isEmpty():
                break
            if d or D:
                open_ = walks(open_, d, D) if d < max_d else open_.withColumn("walks", F.lit(False))
            out.append(open_.filter(~F.col("walks")).select(*keys, F.lit(d).alias("d"), F.lit(D).alias("seasonal_d")))
            open_ = open_.filter("walks").select(*keys, "walks")
    return cut(reduce(DataFrame.unionByName, out))


def arima_order_select(df: DataFrame, *, max_p: int = 5, max_q: int = 5, max_P: int = 2, max_Q: int = 2, s: int = 7, max_d: int = 2,
                       differences: DataFrame | None = None, exog: Sequence[str] = (), y: str = "price_move", order: SeriesOrder = DAILY) -> DataFrame:
    """The orders (p, d, q) and (P, D, Q) of every series: differences by tests, or as `differences` (keys, d, seasonal_d) says, the others by the lowest AIC.

    All orders with the same differences are solved from the sums of the largest one, so they share one pass and one sample;
    no order is left out. Equal fits go to the one with fewer terms.
    """
    keys = list(order.keys)
    told = detect_differences(df, y, s=s, max_d=max_d, order=order) if differences is None else differences
    pairs = sorted(tuple(r) for r in told.select("d", "seasonal_d").distinct().collect())  # no more than (max_d + 1) * 2
    out = []
    for d, D in pairs:
        widest = Arx(max_p, max_P, s, d, tuple(exog), y, max_q, max_Q, D)
        own = told.filter((F.col("d") == d) & (F.col("seasonal_d") == D)).select(*keys, F.lit(True).alias("_wanted"))
        rows = order.cut(with_lags(join_on(df, own, keys).drop("_wanted"), widest, order))
        xs, choices = widest.regressors(), _choices(widest)
        fits = fit_summed(normal_equations(with_shocks(rows, widest, order), xs, "_y", keys), len(xs), keys, sorted(choices, key=len))
        named = F.create_map(*(F.lit(v) for at, orders in choices.items() for v in (",".join(map(str, at)), ",".join(map(str, orders)))))
        chosen = F.split(named[F.array_join("used", ",")], ",")
        out.append(fits.select(*keys, *(chosen[i].cast("int").alias(n) for i, n in enumerate(("p", "seasonal_p", "q", "seasonal_q"))),
                               F.lit(d).alias("d"), F.lit(D).alias("seasonal_d"), "n", "sse", "aic", "bic", "coef"))
    return reduce(DataFrame.unionByName, out)


def _effective(model: Arx) -> int:
    return max(model.reach(), 1)


def _lag_polynomial(model: Arx, coef: np.ndarray) -> np.ndarray:
    """Weights of the last values, latest first, once the differences are undone."""
    ar = np.zeros(_effective(model) + 1 - model.d - model.s * model.D)
    ar[0] = 1.0
    for i, k in enumerate(model.lags()):
        ar[k] -= coef[1 + i]
    for _ in range(model.d):
        ar = np.convolve(ar, [1.0, -1.0])
    for _ in range(model.D):
        ar = np.convolve(ar, [1.0, *[0.0] * (model.s - 1), -1.0])
    weights = np.zeros(_effective(model))
    weights[: len(ar) - 1] = -ar[1:]
    return weights


def _run(weights: np.ndarray, drive: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forecast step by step; `state` holds the last values, latest first."""
    out = np.empty(len(drive))
    for i, u in enumerate(drive):
        out[i] = u + weights @ state
        state = np.concatenate(([out[i]], state[:-1]))
    return out, state


def _companion(weights: np.ndarray) -> np.ndarray:
    m = len(weights)
    a = np.zeros((m, m))
    a[0] = weights
    a[1:, :-1] = np.eye(m - 1)
    return a


def multi_step(rows: DataFrame, history: DataFrame, fits: DataFrame, model: Arx, order: SeriesOrder,
               stretch: int = BLOCK_ROWS) -> DataFrame:
    """Forecast `rows` from the end of `history` on, feeding forecasts back as lags.

    A long horizon is cut into stretches. The recursion is linear, so each stretch first runs from an
    empty state; its end state and the power of its step matrix say how it moves any start state.
    Start states follow from one short row per stretch, and the stretches then run on their own. Shocks to come are 0, so the
    last known ones move only as many rows as they reach.
    """
    keys, m, lags = list(order.keys), _effective(model), model.shock_lags()
    ends = history.groupBy(*keys).agg(F.max("idx").alias("_end"))
    shock = F.col("_shock") if lags else F.lit(None).cast("double")
    recent = attach(history.select(*keys, "idx", model.y, shock.alias("_shock")), ends, keys).filter(F.col("idx") > F.col("_end") - max([m, *lags]))
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("idx")).alias("at"), F.col(model.y).alias("v"), F.col("_shock").alias("e"))))
    # At most one value per lag is collected.
    start = recent.groupBy(*keys).agg(F.slice(F.transform(pairs, lambda e: e["v"]), 1, m).alias("_state"), F.max("_end").alias("_end"),
                                      F.transform(pairs, lambda e: e["e"]).alias("_shocks"))
    known = join_on(fits.select(*keys, "coef"), start, keys)
    drive = F.col("coef")[0]
    for i, c in enumerate(model.exog):
        drive = drive + F.col("coef")[1 + len(model.lags()) + i] * F.col(c).cast("double")
    for i, k in enumerate(lags):
        past = F.coalesce(F.expr(f"get(_shocks, CAST({k} - (idx - _end) AS INT))"), F.lit(0.0))
        drive = drive + F.col("coef")[1 + len(model.lags()) + len(model.exog) + i] * F.when(F.col("idx") - F.col("_end") <= k, past).otherwise(0.0)
    steps = attach(rows.select(*keys, "idx", *model.exog), known, keys, how="inner")
    steps = steps.select(*keys, "idx", drive.alias("drive"), "coef", "_state",
                         F.floor((F.col("idx") - F.col("_end") - 1) / F.lit(stretch)).alias("stretch"))
    key_type = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    out_type = f"{key_type}, idx bigint, y_pred double"

    def begin(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        weights = _lag_polynomial(model, np.asarray(pdf["coef"].iloc[0], float))
        state = np.zeros(m)
        got = np.asarray(pdf["_state"].iloc[0], float)
        state[: len(got)] = got
        return weights, state

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        weights, state = begin(pdf)
        out, _ = _run(weights, pdf["drive"].to_numpy(float), state)
        return pdf[[*keys, "idx"]].assign(y_pred=out)

    if not order.blocked(rows):
        return steps.groupBy(*keys).applyInPandas(run, out_type)

    end_type = f"{key_type}, stretch bigint, steps bigint, ended array<double>, coef array<double>, _state array<double>"

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        weights, _ = begin(pdf)
        _, last = _run(weights, pdf["drive"].to_numpy(float), np.zeros(m))
        return pdf[[*keys, "stretch", "coef", "_state"]].head(1).assign(steps=len(pdf), ended=[last.tolist()])[
            [*keys, "stretch", "steps", "ended", "coef", "_state"]]

    def hand_over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stretch")
        weights, state = begin(pdf)
        a, starts = _companion(weights), []
        for n, ended in zip(pdf["steps"], pdf["ended"]):
            starts.append(state.tolist())
            state = np.linalg.matrix_power(a, int(n)) @ state + np.asarray(ended, float)
        return pdf[[*keys, "stretch"]].assign(_state=starts)

    ended = steps.groupBy(*keys, "stretch").applyInPandas(end, end_type)
    starts = ended.groupBy(*keys).applyInPandas(hand_over, f"{key_type}, stretch bigint, _state array<double>")
    return (join_on(steps.drop("_state"), starts, [*keys, "stretch"])
            .groupBy(*keys, "stretch").applyInPandas(run, out_type))


def arx_forecast(df: DataFrame, model: Arx = Arx(), *, split: str = "split", stretch: int = BLOCK_ROWS,
                 order: SeriesOrder = DAILY) -> DataFrame:
    """Forecast the validation rows from a fit on training, and the test rows from a fit on both.

    Adds `y_pred` to the validation and test rows. The test forecast starts after the last known value.
    """
    rows = order.cut(with_lags(df, model, order))
    keys, tables = list(order.keys), []
    for target, seen in (("val", ("train",)), ("test", ("train", "val"))):
        past = with_shocks(rows.filter(F.col(split).isin(*seen)), model, order)
        fits = arx_fit(past, model, keys)
        tables.append(multi_step(rows.filter(F.col(split) == target), past, fits, model, order, stretch))
    forecasts = tables[0].unionByName(tables[1])
    known = rows.filter(F.col(split).isin("val", "test"))
    known = known.drop("_y", *(c for c in known.columns if c.startswith("_lag")))
    return join_on(known, forecasts, [*keys, "idx"])


# ---- rolling refits ------------------------------------------------------------------------------

def _stretch_of(refit_every: int, max_history: int) -> tuple[Column, int, int]:
    """The stretch of a row, how many stretches a window spans, and how many lie between refit points.

    Where a window begins inside the rows between two refit points, those are two stretches, cut where it begins.
    """
    whole, rest = divmod(max_history, refit_every)
    at = F.floor(F.col("idx") / F.lit(refit_every))
    if not rest:
        return at, whole, 1
    return at * 2 + (F.pmod(F.col("idx"), F.lit(refit_every)) >= refit_every - rest).cast("long"), 2 * whole + 1, 2


def refit_range_join(df: DataFrame, stats: dict[str, Column], combine: dict[str, Column], *, refit_every: int = 50,
                     max_history: int = 1000, order: SeriesOrder = DAILY) -> DataFrame:
    """Per refit point (`cut`, a position) statistics of the `max_history` rows before it.

    Rows are first summed per stretch between refit points (`stats`); a window over the stretches then
    combines those in range of a refit point (`combine`, aggregates over the summed columns).
    """
    rows = df if "idx" in df.columns else SeriesFrame.open(df, order).index("idx").close()
    chunk, span, between = _stretch_of(refit_every, max_history)
    sums = rows.groupBy(*order.keys, chunk.alias("_chunk")).agg(*(c.alias(n) for n, c in stats.items()))
    sums, stretches = _stretches(sums, rows, order)

    def before(w: WindowSpec) -> dict[str, Column]:
        reach = w.rowsBetween(-span, -1)
        return {"_any": F.count(F.lit(1)).over(reach), **{n: c.over(reach) for n, c in combine.items()}}

    found = windowed(stretches.cut(sums), before, order=stretches, lookback=span).filter((F.col("_any") > 0) & (F.col("_chunk") % between == 0))
    return found.select(*order.keys, (F.floor(F.col("_chunk") / between) * refit_every).alias("cut"), *combine)


def _stretches(sums: DataFrame, rows: DataFrame, order: SeriesOrder) -> tuple[DataFrame, SeriesOrder]:
    """Sums per stretch with the order of the stretches; `_chunk` numbers them without holes."""
    if order.blocked(rows):
        return sums, replace(order, ts="_chunk", tie=(), bucket_at=None)
    # Numbered by days, so that a short series stays whole.
    return sums.withColumn("_day", F.date_from_unix_date(F.col("_chunk").cast("int"))), SeriesOrder(order.keys, "_day")


def rolling_arx_forecast(df: DataFrame, model: Arx = Arx(), *, refit_every: int = 50, max_history: int = 1000,
                         order: SeriesOrder = DAILY) -> DataFrame:
    """One-step forecasts with actual lags, refitted every `refit_every` rows on the rows before.

    Adds `y_pred`; rows before the first possible fit have none. With shocks the first stage is a rolling forecast of its own:
    a row's shock is what that one missed, so no row sees a fit of later rows.
    """
    if model.shock_lags():
        first = rolling_arx_forecast(df, model.first_stage(), refit_every=refit_every, max_history=max_history, order=order)
        missed = order.cut(first.withColumn("_shock", F.col(model.y) - F.col("y_pred")).drop("y_pred"))
        names = [f"_shock{k}" for k in model.shock_lags()]
        told = windowed(missed, lambda w: {n: F.lag("_shock", k).over(w) for n, k in zip(names, model.shock_lags())}, order=order, lookback=model.shock_lags()[-1])
        second = replace(model, q=0, Q=0, exog=(*model.exog, *names))
        return rolling_arx_forecast(told, second, refit_every=refit_every, max_history=max_history, order=order).drop("_shock", *names)
    rows = order.cut(with_lags(df, model, order))
    xs, y = model.regressors(), "_y"
    products = cross_sums(xs, y)
    chunk, span, between = _stretch_of(refit_every, max_history)
    marked = rows.withColumn("_chunk", chunk)
    # Every stretch keeps a row, also one without complete values.
    sums = marked.groupBy(*order.keys, "_chunk").agg(
        *(F.expr(f"coalesce(sum(CASE WHEN {complete(xs, y)} THEN {c} END), 0D)").alias(n) for n, c in products.items()))
    sums, stretches = _stretches(sums, df, order)
    before = windowed(stretches.cut(sums), lambda w: {n: F.expr(f"sum({n})").over(w.rowsBetween(-span, -1)) for n in products},
                      order=stretches, lookback=span)
    fits = fit_summed(before.filter((F.col("n") > len(xs)) & (F.col("_chunk") % between == 0)), len(xs), [*order.keys, "_chunk"])
    refit = F.floor(F.col("_chunk") / between) * between
    joined = join_on(marked.withColumn("_chunk", refit), fits.select(*order.keys, "_chunk", "coef"), [*order.keys, "_chunk"], "left")
    # What differencing takes from a value are earlier values, which are known.
    undone = F.col(model.y) - F.col("_y") if model.d or model.D else F.lit(0.0)
    out = joined.withColumn("y_pred", predict("coef", xs) + undone)
    return out.drop("_chunk", "coef", "_y", *(f"_lag{k}" for k in model.lags()))


# ---- stationarity --------------------------------------------------------------------------------

def critical_value(n: Column, level: float = 0.05) -> Column:
    b0, b1, b2, b3 = CRITICAL[level]
    return F.lit(b0) + b1 / n + b2 / (n * n) + b3 / (n * n * n)


def longest_lag(n: Column) -> Column:
    """How many lagged steps a series of n values may have: 12 * (n / 100) ** (1/4), and half the series less the regressors."""
    return F.greatest(F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2), F.lit(0)).cast("int")


def dickey_fuller_p(statistic: Column) -> Column:
    """Probability of a value as low as this one if there is a unit root, from the published polynomials."""
    def p(t: float | None) -> float | None:
        if t is None or np.isnan(t):
            return None
        if t > P_RANGE[2]:
            return 1.0
        if t < P_RANGE[0]:
            return 0.0
        at = np.polynomial.polynomial.polyval(t, P_LOW if t <= P_RANGE[1] else P_HIGH)
        return 0.5 * (1.0 + erf(float(at) / sqrt(2.0)))

    @F.pandas_udf("double")
    def each(values: pd.Series) -> pd.Series:
        return values.map(p)

    return each(statistic)


def _unit_root_fits(frame: DataFrame, lags: DataFrame, widest: int, only: bool, order: SeriesOrder) -> DataFrame:
    """keys, lags, n, t_before: the fit with the lowest AIC of up to `_lags` lagged steps for each series, or of all of them.

    The sums are linear in the lags: products of two lagged steps depend on the difference of their lags, but for the rows at
    either end of a run of complete rows, and those ends are a few rows per run.
    """
    keys = list(order.keys)
    steps = [f"_step{k}" for k in range(1, widest + 1)]
    # A lag beyond a series' own is 0 everywhere, so it takes no row away.
    own = {c: F.when(F.col("_lags") >= k, F.col(c)).otherwise(F.lit(0.0)) for k, c in enumerate(steps, 1)}
    rows = attach(frame, lags, keys, how="inner").withColumns(own)
    rows = rows.withColumn("_whole", F.expr(complete([*steps, "_before"], "_step")))
    whole = rows.filter("_whole")
    lagged = ["_step", *steps]
    sums = whole.groupBy(*keys).agg(
        F.first("_lags").alias("_lags"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("_before").alias("level"), F.expr("sum(_before * _before)").alias("levels"),
        F.array(*(F.expr(f"sum({c})") for c in lagged)).alias("totals"), F.array(*(F.expr(f"sum(_before * {c})") for c in lagged)).alias("across"),
        F.array(*(F.expr(f"sum(_step * {c})") for c in lagged)).alias("first"))
    beside = windowed(rows.select(*order.columns(), "idx", "_lags", "_whole", *lagged),
                      lambda w: {"_begins": F.col("_whole") & ~F.coalesce(F.lag("_whole").over(w), F.lit(False)),
                                 "_ends": F.col("_whole") & ~F.coalesce(F.lead("_whole").over(w), F.lit(False))}, order=order, lookback=1, lookahead=1)
    sides = F.array(F.struct(F.col("_begins").alias("at"), F.lit(1.0).alias("sign"), F.array(*steps).alias("values")),
                    F.struct(F.col("_ends").alias("at"), F.lit(-1.0).alias("sign"), F.array(*lagged[:-1]).alias("values")))
    # A run of whole rows and the gap before it are longer than the lags, so a bucket has 2,048 ends or a few more.
    ends = beside.filter("_begins OR _ends").select(*keys, F.floor(F.col("idx") / (1024 * (widest + 1))).alias("_bucket"), F.explode(sides).alias("side")).filter("side.at")
    key_type = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema if f.name in keys)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.array([np.asarray(x["values"], float) for x in pdf["side"]]).reshape(len(pdf), widest)
        sign = np.array([x["sign"] for x in pdf["side"]])
        return pdf[keys].head(1).assign(edges=[(values.T @ (values * sign[:, None])).ravel().tolist()])

    if widest:
        edges = ends.groupBy(*keys, "_bucket").applyInPandas(products, f"{key_type}, edges array<double>")
        edges = edges.select(*keys, F.posexplode("edges").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
        edges = edges.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("edges"))
        sums = join_on(sums, edges, keys)
    else:
        sums = sums.withColumn("edges", F.array().cast("array<double>"))

    @F.pandas_udf(NESTED_TYPE)
    def solved(lags: pd.Series, n: pd.Series, level: pd.Series, levels: pd.Series, totals: pd.Series, across: pd.Series, first: pd.Series, edges: pd.Series) -> pd.DataFrame:
        found = []
        for k, n_, level_, levels_, *arrays in zip(lags, n, level, levels, totals, across, first, edges):
            totals_, across_, first_, edges_ = (np.asarray(x, float) for x in arrays)
            between = shifted_products(first_[: k + 1], edges_.reshape(widest, widest)[:k, :k])
            a = np.zeros((k + 2, k + 2))
            a[0, 0], a[0, 1], a[1, 1], a[0, 2:], a[1, 2:] = n_, level_, levels_, totals_[1: k + 1], across_[1: k + 1]
            a = np.triu(a) + np.triu(a, 1).T
            a[2:, 2:] = between[1:, 1:]
            fit = nested_fit(a, np.array([totals_[0], across_[0], *first_[1: k + 1]]), first_[0], n_, 2, only)
            found.append((*fit, n_) if fit else (None, None, n_))
        return pd.DataFrame([(k, n_, t) for k, t, n_ in found], columns=["lags", "n", "t_before"]).astype({"lags": "Int32"})

    return sums.withColumn("_fit", solved("_lags", "n", "level", "levels", "totals", "across", "first", "edges")).select(*keys, "_fit.*")


def stationarity_test(df: DataFrame, y: str = "price_move", *, max_lag: int | None = None, level: float = 0.05,
                      order: SeriesOrder = DAILY) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant for every series, its lags chosen by AIC.

    The most lags follow from the length of each series, or are `max_lag`. All choices for a series share
    the sample that the largest one leaves; the chosen one is fitted again on all rows it can use.
    """
    if level not in CRITICAL:
        raise ValueError(f"level must be one of {sorted(CRITICAL)}, got {level}")
    keys = list(order.keys)
    counted = df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    limits = counted.select(*keys, (longest_lag(F.col("_rows")) if max_lag is None else F.lit(max_lag)).alias("_lags"))
    widest = (limits.agg(F.max("_lags")).first()[0] or 0) if max_lag is None else max_lag
    frame = SeriesFrame.open(df, order, lookback=widest + 2)
    frame = frame if "idx" in df.columns else frame.index("idx")
    for step in (lambda w: {"_before": F.lag(y).over(w)}, lambda w: {"_step": F.col(y) - F.col("_before")},
                 lambda w: {f"_step{k}": F.lag("_step", k).over(w) for k in range(1, widest + 1)}):
        frame = frame.with_columns(step)
    steps = cut(frame.close().select(*order.columns(), "idx", "_before", "_step", *(f"_step{k}" for k in range(1, widest + 1))))
    chosen = _unit_root_fits(steps, limits, widest, False, order).filter("lags IS NOT NULL").select(*keys, F.col("lags").alias("_lags"))
    found = _unit_root_fits(steps, cut(chosen), widest, True, order).filter("lags IS NOT NULL")
    limit = critical_value(F.col("n"), level)
    return found.select(*keys, F.col("t_before").alias("statistic"), "lags", "n",
                        dickey_fuller_p(F.col("t_before")).alias("p_value"), limit.alias("critical"), (F.col("t_before") < limit).alias("is_stationary"))
