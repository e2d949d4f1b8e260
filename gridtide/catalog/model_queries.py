"""Sources, sinks, scalar functions and models."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.catalog.feature_queries import CALENDAR_V2, CLEAN_SQL, V2_DOUBLES, v2_sql
from gridtide.catalog.inputs import (MARKET_SQL, NAIVE_SQL, PRICED_SQL, SCORES_SQL, event_order, market, naive_forecast, priced, rounded,
                                     scores)
from gridtide.functions import scalars as U
from gridtide.models.arx import (Arx, arima_order_select, arx_forecast, arx_order_select, refit_range_join, rolling_arx_forecast, seasonal_critical,
                                 stationarity_test)
from gridtide.models.contract import prepared
from gridtide.models.kernel import rbf_regression
from gridtide.models.registry import best_by_metric, default_registry, horizon_sweep, run_models, seq_len_sweep, union_results
from gridtide.models.search import hyperparameter_search
from gridtide.models.recurrent import reservoir_model
from gridtide.models.trees import feature_importance_topn, feature_importances, gradient_boosting, random_forest
from gridtide.operators.features import exog_returns
from gridtide.operators.statistics import price_summary
from gridtide.operators.targets import split_chronological
from gridtide.operators.trading import trading_metrics
from gridtide.plans.dataset import make_dataset
from gridtide.session import cut, scratch_dir
from gridtide.sources import market as K
from gridtide.sources.results import ExperimentStore, load_model, read_results, save_model, write_results

KEY = ("series_id", "trade_date")
EXOG = ("gas_price", "temperature", "pjm_load")


# ---- sources and sinks ---------------------------------------------------------------------------

TRADE, START, END = K.DATE_COLUMNS
RAW = {short: long for long, short in K.CORE_COLUMNS.items()}


def _csv(spark, sf):
    """The market written under its raw headings, with some dates spoiled."""
    rows = market(spark, sf)
    day = F.col("trade_date")
    text = F.when(F.dayofmonth(day) == 31, "xx").otherwise(day.cast("string"))
    out = rows.select("series_id", day.cast("string").alias(TRADE), text.alias(START), F.date_add(day, 1).cast("string").alias(END),
                      *(F.col(c).alias(RAW[c]) for c in K.CORE))
    return write_results(out, scratch_dir(spark, "market-csv"))


def _wide(spark, sf):
    """A file without a series, its columns in another order among many others, its dates in another spelling, a number spoiled."""
    rows, day = market(spark, sf), F.col("trade_date")
    spoiled = F.when(F.dayofmonth(day) == 5, "n/a").otherwise(F.col("volume").cast("string"))
    out = rows.select(F.col("series_id").alias("Comment, free text"), *(F.col(c).alias(RAW[c]) for c in reversed(K.CORE) if c != "volume"),
                      *(F.lit(i).alias(f"Other: series {i}") for i in range(40)), F.date_format(day, "M/d/yyyy").alias(TRADE), spoiled.alias(RAW["volume"]))
    path = write_results(out, scratch_dir(spark, "market-csv"))
    return K.core_projection(K.parse_dates(K.scan_market_csv(spark, path, keep=["Other: series 7", "Comment, free text"])),
                             keep=("series_id", "Other: series 7", "Comment, free text"))


def _scan(spark, sf):
    return K.scan_market_csv(spark, _csv(spark, sf))


def _require(spark, sf):
    return K.core_projection(K.parse_dates(K.require_columns(_scan(spark, sf), list(K.CORE_COLUMNS)))).select(*KEY, *K.CORE)


SUMMARY = ("series_id string, rows long, days int, avg_price double, min_price double, max_price double, std_price double, "
           "volatility_pct double")


def _write(spark, sf):
    path = write_results(rounded(price_summary(market(spark, sf))), scratch_dir(spark, "results"))
    return read_results(spark, path, SUMMARY)


def _experiments(spark, sf):
    """One experiment per series: its period, and the metrics of each side of the prediction."""
    store = ExperimentStore(spark, scratch_dir(spark, "experiments"))
    stats = price_summary(market(spark, sf))
    metrics = F.create_map(F.lit("avg"), F.round("avg_price", 6), F.lit("max"), F.round("max_price", 6))
    store.save_experiments(stats.select(
        F.concat(F.lit("run_"), "series_id").alias("experiment_id"),
        F.create_map(F.lit("days"), F.col("days").cast("string")).alias("data_split"),
        F.create_map(F.lit("summary"), metrics).alias("models"), F.lit("summary").alias("best_model"), F.lit(None).cast("string").alias("notes")))
    return store.list_experiments().join(store.load_experiments(), "experiment_id", "left").select(
        "experiment_id", F.col("data_split")["days"].alias("days"), F.col("models")["summary"]["avg"].alias("avg_price"), "best_model")


# ---- models --------------------------------------------------------------------------------------

def _data(spark, sf, task="sign", **options):
    return prepared(make_dataset(market(spark, sf), task, **options))


def _held_out(data, fitted, low=None, high=None):
    """The held-out rows with their targets, whether each prediction is a number that the task allows, the error of the best constant
    of the training rows on the held-out ones, and whether the model's is less. The error is the mean square, or the share of wrong classes."""
    fine = F.col("y_pred").isNotNull() & ~F.isnan("y_pred")
    if low is not None:
        fine = fine & F.col("y_pred").between(low, high)
    train = data.rows.filter("split = 'train'").select(F.col("y_target").cast("double").alias("y"))
    y = F.col("y_target").cast("double")
    if data.task == "sign_3class":
        constant = train.groupBy("y").count().orderBy(F.desc("count"), "y").first()["y"]
        errors = [(y != p).cast("double") for p in (F.col("y_pred"), F.lit(constant))]
    else:
        constant = train.agg(F.avg("y")).first()[0]
        errors = [(y - p) * (y - p) for p in (F.col("y_pred"), F.lit(constant))]
    predicted = cut(fitted.predictions)
    own, plain = predicted.agg(*map(F.avg, errors)).first()
    return rounded(predicted.select(*KEY, "idx", "split", y.alias("y_target"), "ret_fwd", fine.alias("fine"), F.lit(plain).alias("constant_error"), F.lit(own < plain).alias("beats")))


def _model(run, task="sign", low=None, high=None, **options):
    """A query: a model with the library's defaults on the dataset of a task."""
    def query(spark, sf):
        data = _data(spark, sf, task, **options)
        return _held_out(data, run(data, {"seq_len": options["seq_len"]} if options else {}), low, high)

    return query


def _importance(spark, sf):
    """All importances: one per feature, none negative, one in sum, the best ones first."""
    fitted = random_forest(_data(spark, sf, "price"), {})
    ranked = feature_importance_topn(feature_importances(spark, fitted), len(fitted.names))
    return ranked.select("feature", (F.col("importance") >= 0).alias("fine"), F.round(F.sum("importance").over(Window.partitionBy()), 6).alias("total"))


SPACE = {"n_estimators_options": [(5,), (10,)], "max_depth": (2, 5), "min_samples_leaf": (1, 20)}


def _search(spark, sf):
    """All draws with their scores as shares of right signs; the first of the best ones is marked."""
    found = hyperparameter_search(_data(spark, sf), random_forest, SPACE)
    best = F.min(F.when(F.col("score") == F.col("top"), F.col("draw"))).over(Window.partitionBy())
    found = found.withColumn("top", F.max("score").over(Window.partitionBy()))
    return found.select("draw", "metric", F.col("score").between(0, 1).alias("fine"), (F.col("is_best") == (F.col("draw") == best)).alias("marked"))


def _store(spark, sf):
    """A stored model predicts what the fitted one did, row by row."""
    data = _data(spark, sf, "price")
    fitted = random_forest(data, {})
    model, about = load_model(spark, save_model(spark, fitted.model, scratch_dir(spark, "model"), fitted.params))
    again = model.transform(data.rows.filter(F.col("split") != "train")).select(*KEY, "prediction")
    both = fitted.predictions.join(again, list(KEY))
    return both.select(*KEY, "split", (F.abs(F.col("prediction") - F.col("y_pred")) < 1e-12).alias("same"),
                       F.lit(about["n_estimators"] in (100, 200, 500)).alias("described"))


def _swept(table, *columns):
    return table.select("model_name", *columns, F.col("trading_total_trades").alias("trades"), (F.col("base_mae") > 0).alias("fine"), "error")


def _moves(spark, sf):
    return split_chronological(exog_returns(priced(spark, sf)))


def _arx(spark, sf):
    out = arx_forecast(_moves(spark, sf), Arx(2, 1, 7, 0, EXOG))
    return rounded(out.select("series_id", "idx", "split", "price_move", "y_pred"), 5)


def _rolling(spark, sf):
    out = rolling_arx_forecast(_moves(spark, sf), Arx(2, 1, 7, 0, EXOG))
    return rounded(out.filter("y_pred IS NOT NULL").select("series_id", "idx", "price_move", "y_pred"), 5)


def _moving(spark, sf):
    out = arx_forecast(_moves(spark, sf), Arx(2, 1, 7, 0, EXOG, q=1, Q=1))
    return rounded(out.select("series_id", "idx", "split", "price_move", "y_pred"), 5)


def _rolling_difference(spark, sf):
    """One lag of the steps between steps, from the last 730 rows before a refit."""
    out = rolling_arx_forecast(_moves(spark, sf), Arx(1, 0, 7, 2), max_history=730)
    return rounded(out.filter("y_pred IS NOT NULL").select("series_id", "idx", "y_pred"), 5)


def _single_lag(spark, sf):
    """With one lag and nothing else the rolling fit has a closed form."""
    out = rolling_arx_forecast(_moves(spark, sf), Arx(1, 0, 7, 0))
    return rounded(out.filter("y_pred IS NOT NULL").select("series_id", "idx", "y_pred"), 5)


def _recursive_lag(spark, sf):
    """With one lag the fit is a line and the forecast feeds itself."""
    out = arx_forecast(_moves(spark, sf), Arx(1, 0, 7, 0))
    return rounded(out.select("series_id", "idx", "split", "y_pred"))


def _dickey_fuller(spark, sf):
    """Without lagged steps the test is the t value of a line's slope."""
    return rounded(stationarity_test(_moves(spark, sf), max_lag=0).drop("p_value"), 4)


def _events_arx(spark, sf):
    """Long series: the naive residual of events, forecast one step ahead."""
    order = event_order(spark, sf)
    out = rolling_arx_forecast(order.cut(naive_forecast(spark, sf, order)), Arx(1, 0, 7, 0, (), "residual"), order=order)
    return rounded(out.filter("y_pred IS NOT NULL").select("event_type", "idx", "y_pred"), 4)


def _refits(spark, sf, history=1000):
    rows = priced(spark, sf)
    return rounded(refit_range_join(
        rows, {"n": F.count(F.lit(1)), "first": F.min("trade_date"), "last": F.max("trade_date"), "total": F.sum("price")},
        {"n": F.sum("n"), "first": F.min("first"), "last": F.max("last"), "total": F.sum("total")}, max_history=history), 4)


def _registry(spark, sf):
    """All models of the default registry: the rows they were scored on, and their errors."""
    return run_models(market(spark, sf)).select("model_name", "task_type", F.col("trading_total_trades").alias("trades"), "error")


def _union(spark, sf):
    summary = price_summary(market(spark, sf), by=["series_id"])
    return rounded(union_results([summary.select("series_id", "avg_price"), summary.select("series_id", "max_price")]))


def _json(spark, sf):
    """An object with a list of lists, a missing value and a map."""
    y = F.col("y")
    return scores(spark, sf).select("doc_id", U.json_encode(
        doc=F.col("doc_id"), matrix=F.array(F.array(y, 1 - y), F.array(F.lit(0), F.lit(1))), none=F.lit(None).cast("int"),
        named=F.create_map(F.lit("y"), y)).alias("doc"))


def _best(spark, sf):
    rows = trading_metrics(naive_forecast(spark, sf).withColumnsRenamed({"y_true": "actual", "y_pred": "pred"}), by=["event_type"])
    ranked = rows.select(F.col("event_type").alias("model_name"), F.col("win_rate").alias("trading_win_rate"),
                         F.col("sharpe").alias("trading_sharpe"), (-F.col("avg_return")).alias("base_mae"))
    return rounded(best_by_metric(ranked))


QUERIES = {
    "scan_market_csv": lambda s, d: K.core_projection(K.parse_dates(_scan(s, d))).select(*KEY, *K.CORE),
    "parse_dates": lambda s, d: K.core_projection(K.parse_dates(_scan(s, d))).select(*KEY, "delivery_start", "delivery_end"),
    "require_columns": _require,
    "write_results": _write,
    "experiment_store": _experiments,
    "scan_market_csv_wide": _wide,
    "union_results": _union,
    "sigmoid": lambda s, d: rounded(scores(s, d).select("doc_id", U.sigmoid(F.col("p") * 4 - 2).alias("v"))),
    "scaled_sigmoid": lambda s, d: rounded(scores(s, d).select(
        "doc_id", U.return_to_probability(F.col("p") / 10 - 0.05).alias("from_return"), U.score_to_probability(F.col("p")).alias("from_score"))),
    "clip": lambda s, d: rounded(scores(s, d).select("doc_id", U.clip(F.col("p"), 0.2, 0.7).alias("v"))),
    "minmax_normalise": lambda s, d: rounded(scores(s, d).select("doc_id", U.minmax_normalise(F.col("p") * 40 - 20, -20, 20).alias("v"))),
    "direction_label": lambda s, d: scores(s, d).select("doc_id", U.direction_label(F.col("p")).alias("v")),
    "json_encode": _json,
    "experiment_id": lambda s, d: market(s, d).select(
        *KEY, U.experiment_id(F.col("trade_date").cast("timestamp") + F.expr("INTERVAL '3:04:05' HOUR TO SECOND")).alias("experiment_id")),
    "refit_range_join": _refits,
    "refit_range_join_730": lambda s, d: _refits(s, d, 730),
    "arx_forecast_moving": _moving,
    "rolling_arx_twice_differenced": _rolling_difference,
    "arima_order_select": lambda s, d: rounded(arima_order_select(_moves(s, d)).drop("coef"), 4),
    "rolling_arx_single_lag": _single_lag,
    "events_rolling_arx": _events_arx,
    "arx_forecast_single_lag": _recursive_lag,
    "stationarity_test_plain": _dickey_fuller,
    "best_by_metric": _best,
    "model_store": _store,
    "random_forest": _model(random_forest, "sign", 0.0, 1.0),
    "gradient_boosting": _model(gradient_boosting, "price"),
    "feature_importance_topn": _importance,
    "hyperparameter_search": _search,
    "rbf_regression": _model(rbf_regression, "price"),
    "arx_forecast": _arx,
    "arx_order_select": lambda s, d: rounded(arx_order_select(_moves(s, d)).drop("coef"), 4),
    "rolling_arx_forecast": _rolling,
    "stationarity_test": lambda s, d: rounded(stationarity_test(_moves(s, d)).drop("p_value"), 4),
    "sequence_model": _model(reservoir_model, "sign", 0.0, 1.0, seq_len=14),
    "seq_len_sweep": lambda s, d: _swept(seq_len_sweep(market(s, d)), "seq_len"),
    "horizon_sweep": lambda s, d: _swept(horizon_sweep(market(s, d)), "horizon"),
    "model_registry_run": _registry,
    "model_contract": _model(gradient_boosting, "sign_3class", 0.0, 2.0),
    "sequence_model_3class": _model(reservoir_model, "sign_3class", 0.0, 2.0, seq_len=14),
    "sequence_model_price": _model(reservoir_model, "price", seq_len=14),
}

O = "WINDOW o AS (PARTITION BY series_id ORDER BY trade_date)"  # noqa: E741


def single_lag_sql(views: str, source: str, key: str, y: str, places: int) -> str:
    """Every refit point with the rows of its range, joined by a range condition."""
    return f"""WITH {views},
p AS (SELECT *, lag({y}) OVER (PARTITION BY {key} ORDER BY idx) AS l FROM {source}),
cuts AS (SELECT DISTINCT {key}, idx // 50 * 50 AS cut FROM p),
fits AS (SELECT c.{key}, c.cut, regr_slope(p.{y}, p.l) AS b, regr_intercept(p.{y}, p.l) AS a
       FROM cuts c JOIN p ON p.{key} = c.{key} AND p.idx < c.cut AND p.idx >= c.cut - 1000 AND p.l IS NOT NULL GROUP BY ALL)
SELECT p.{key}, p.idx, round(f.a + f.b * p.l, {places}) AS y_pred FROM p JOIN fits f ON f.{key} = p.{key} AND f.cut = p.idx // 50 * 50
WHERE p.l IS NOT NULL"""


MOVES_SQL = f"""{PRICED_SQL}, moves AS (SELECT series_id, row_number() OVER o - 1 AS idx, coalesce(price / lag(price) OVER o - 1, 0) AS m FROM priced {O})"""

def labelled_sql(target: str, horizon: int = 1) -> str:
    """Rows of a dataset with targets, positions and splits."""
    ahead = f"lead(price, {horizon}) OVER o / " + ("price" if horizon == 1 else f"lead(price, {horizon - 1}) OVER o") + " - 1"
    return f"""{CLEAN_SQL}, {v2_sql('clean')},
labelled AS (SELECT series_id, trade_date, {ahead} AS ret_fwd FROM v2 {O}),
known AS (SELECT *, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n FROM labelled WHERE ret_fwd IS NOT NULL {O}),
data AS (SELECT *, {target} AS y_target, CASE WHEN idx < n - floor(n * 0.15) - floor(n * 0.15) THEN 'train'
       WHEN idx < n - floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM known),
steps AS (SELECT *, row_number() OVER (PARTITION BY series_id, split ORDER BY trade_date) AS step FROM data)"""


SIGN = "CAST(CASE WHEN ret_fwd > 0 THEN 1 ELSE 0 END AS DOUBLE)"
THREE = "CAST(CASE WHEN ret_fwd > 0.001 THEN 2 WHEN ret_fwd < -0.001 THEN 0 ELSE 1 END AS DOUBLE)"


def held_out_sql(target: str, seq_len: int = 1, classes: bool = False) -> str:
    """The held-out rows, and what the mean or the most frequent class of the training rows misses on them."""
    constant = "SELECT y_target AS c FROM told WHERE split = 'train' GROUP BY y_target ORDER BY count(*) DESC, y_target LIMIT 1" if classes \
        else "SELECT avg(y_target) AS c FROM told WHERE split = 'train'"
    error = "CASE WHEN y_target <> c THEN 1.0 ELSE 0.0 END" if classes else "(y_target - c) * (y_target - c)"
    return f"""WITH {labelled_sql(target)}, told AS (SELECT * FROM steps WHERE step >= {seq_len}), constant AS ({constant}),
plain AS (SELECT round(avg({error}), 6) AS e FROM told, constant WHERE split <> 'train')
SELECT series_id, trade_date, idx, split, round(y_target, 6) AS y_target, round(ret_fwd, 6) AS ret_fwd, TRUE AS fine, e AS constant_error, TRUE AS beats
FROM told, plain WHERE split <> 'train'"""


def trades_sql(where: str = "step >= 1", horizon: int = 1) -> str:
    """How many test rows a model is scored on."""
    return f"WITH {labelled_sql('ret_fwd', horizon)} SELECT count(*) FROM steps WHERE split = 'test' AND {where}"


def registry_sql() -> str:
    parts = []
    for name, entry in default_registry().items():
        parts.append(f"SELECT '{name}' AS model_name, '{entry.task}' AS task_type, ({trades_sql(f'step >= {entry.dataset.get("seq_len", 1)}')}) AS trades, NULL AS error")
    return " UNION ALL ".join(parts)


def sweep_sql(rows) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS model_name, {value} AS {column}, ({count}) AS trades, TRUE AS fine, NULL AS error"
                              for name, column, value, count in rows)


# Normal equations solved in SQL: a list of rows [a_1 .. a_k | b], brought to the unit matrix column by column.

def matrix_sql(xs: list, y: str) -> str:
    rows = [", ".join(f"sum(({x}) * ({z}))" for z in [*xs, y]) for x in xs]
    return "[" + ", ".join(f"[{r}]" for r in rows) + "]"


def solved_sql(name: str, source: str, keys: str) -> str:
    """`name` has the keys of `source` and `c`, the solution of its `m`."""
    return f"""{name}_walk AS (SELECT {keys}, 1 AS at_row, m FROM {source}
UNION ALL SELECT {keys}, at_row + 1, list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m[1]) + 1), lambda j:
       CASE WHEN i = at_row THEN m[at_row][j] / m[at_row][at_row] ELSE m[i][j] - m[i][at_row] * m[at_row][j] / m[at_row][at_row] END))
       FROM {name}_walk WHERE at_row <= len(m)),
{name} AS (SELECT {keys}, list_transform(m, lambda v: v[len(v)]) AS c FROM {name}_walk WHERE at_row = len(m) + 1)"""


MOVING_SQL = f"""{PRICED_SQL}, moves AS (SELECT *, row_number() OVER o - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n,
       coalesce(price / lag(price) OVER o - 1, 0) AS m0 FROM priced {O}),
split AS (SELECT *, m0 AS price_move, CASE WHEN idx < n - floor(n * 0.15) - floor(n * 0.15) THEN 'train' WHEN idx < n - floor(n * 0.15) THEN 'val' ELSE 'test' END AS split,
       {", ".join(f"lag(m0, {k}) OVER o AS l{k}" for k in (1, 2, 3, 4, 5, 7, 14))} FROM moves {O})"""
ARX_XS = ["1.0", "l1", "l2", "l7", *EXOG]
ARX_COMPLETE = "l7 IS NOT NULL"

ARX_SQL = f"""WITH RECURSIVE {MOVING_SQL},
sums AS (SELECT series_id, 'val' AS split, max(idx) AS e, {matrix_sql(ARX_XS, 'm0')} AS m FROM split WHERE split = 'train' AND {ARX_COMPLETE} GROUP BY series_id
       UNION ALL SELECT series_id, 'test', max(idx), {matrix_sql(ARX_XS, 'm0')} FROM split WHERE split <> 'test' AND {ARX_COMPLETE} GROUP BY series_id),
{solved_sql('fit', 'sums', 'series_id, split, e')},
begun AS (SELECT f.series_id, f.split, f.e, f.c, list(s.m0 ORDER BY s.idx DESC) AS past FROM fit f JOIN split s ON s.series_id = f.series_id AND s.idx BETWEEN f.e - 6 AND f.e
       GROUP BY ALL),
walk AS (SELECT series_id, split, e AS idx, c, past FROM begun
       UNION ALL SELECT w.series_id, w.split, w.idx + 1, w.c, list_prepend(w.c[1] + w.c[2] * w.past[1] + w.c[3] * w.past[2] + w.c[4] * w.past[7]
              + w.c[5] * s.gas_price + w.c[6] * s.temperature + w.c[7] * s.pjm_load, w.past[1:6])
       FROM walk w JOIN split s ON s.series_id = w.series_id AND s.idx = w.idx + 1 AND s.split = w.split)
SELECT s.series_id, s.idx, s.split, round(s.price_move, 5) AS price_move, round(w.past[1], 5) AS y_pred
FROM walk w JOIN split s ON s.series_id = w.series_id AND s.idx = w.idx AND s.split = w.split"""

ROLLING_SQL = f"""WITH RECURSIVE {MOVING_SQL}, cuts AS (SELECT DISTINCT series_id, idx // 50 * 50 AS cut FROM split),
sums AS (SELECT c.series_id, c.cut, count(*) AS rows, {matrix_sql(ARX_XS, 'm0')} AS m FROM cuts c JOIN split s ON s.series_id = c.series_id
       AND s.idx < c.cut AND s.idx >= c.cut - 1000 AND {ARX_COMPLETE} GROUP BY c.series_id, c.cut),
enough AS (SELECT * FROM sums WHERE rows > {len(ARX_XS)}),
{solved_sql('fit', 'enough', 'series_id, cut')}
SELECT s.series_id, s.idx, round(s.price_move, 5) AS price_move,
       round({" + ".join(f"c[{i + 1}] * {x}" for i, x in enumerate(ARX_XS))}, 5) AS y_pred
FROM split s JOIN fit f ON f.series_id = s.series_id AND f.cut = s.idx // 50 * 50 WHERE {ARX_COMPLETE}"""


def unit_root_sql(widest: int = 40) -> str:
    """Lags by AIC on the sample that the longest lag leaves, then the chosen lag on all rows that it leaves itself."""
    xs = ["1.0", "before", *(f"s{k}" for k in range(1, widest + 1))]
    whole = matrix_sql(xs, "y")
    return f"""WITH RECURSIVE {MOVES_SQL},
d AS (SELECT series_id, idx, lag(m) OVER o AS before, m - lag(m) OVER o AS y FROM moves WINDOW o AS (PARTITION BY series_id ORDER BY idx)),
steps AS (SELECT *, {", ".join(f"lag(y, {k}) OVER o AS s{k}" for k in range(1, widest + 1))} FROM d WHERE y IS NOT NULL WINDOW o AS (PARTITION BY series_id ORDER BY idx)),
longest AS (SELECT series_id, least(ceil(12 * pow(count(*) / 100.0, 0.25)), floor(count(*) / 2) - 2)::INTEGER AS most FROM moves GROUP BY series_id),
common AS (SELECT series_id, most, CAST(count(*) AS DOUBLE) AS n, sum(y * y) AS yy, {whole} AS w FROM steps JOIN longest USING (series_id) WHERE idx > most GROUP BY series_id, most),
choices AS (SELECT series_id, k, n, yy, list_transform(w[1:k + 2], lambda v: list_append(v[1:k + 2], v[len(v)])) AS m
       FROM (SELECT *, unnest(range(0, most + 1)) AS k FROM common)),
{solved_sql('fit', 'choices', 'series_id, k')},
scored AS (SELECT series_id, k, n * ln((yy - list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * m[i][len(m[i])]))) / n) + 2 * (k + 2) AS aic
       FROM choices JOIN fit USING (series_id, k)),
best AS (SELECT series_id, k FROM scored QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aic, k) = 1),
again AS (SELECT series_id, k, CAST(count(*) AS DOUBLE) AS n, sum(y * y) AS yy, {whole} AS w FROM steps JOIN best USING (series_id) WHERE idx > k GROUP BY series_id, k),
sides AS (SELECT series_id, k, n, yy, e, list_transform(range(1, k + 3), lambda i: list_append(w[i][1:k + 2],
       CASE WHEN e = 0 THEN w[i][len(w[i])] WHEN i = 2 THEN 1.0 ELSE 0.0 END)) AS m FROM again, (SELECT unnest([0, 1]) AS e)),
{solved_sql('last', 'sides', 'series_id, k, e')},
t AS (SELECT s.series_id, s.k AS lags, s.n, f.c[2] / sqrt((s.yy - list_sum(list_transform(range(1, len(f.c) + 1), lambda i: f.c[i] * s.m[i][len(s.m[i])])))
       / (s.n - s.k - 2) * g.c[2]) AS stat FROM sides s JOIN last f ON f.series_id = s.series_id AND f.e = 0 JOIN last g ON g.series_id = s.series_id AND g.e = 1 WHERE s.e = 0),
c AS (SELECT *, -2.86154 + -2.8903 / n + -4.234 / (n * n) + -40.040 / (n * n * n) AS crit FROM t)
SELECT series_id, round(stat, 4) AS statistic, lags, n, round(crit, 4) AS critical, stat < crit AS is_stationary FROM c"""


def order_sql() -> str:
    """Every choice of lags solved by itself; the lowest AIC, of equal ones the one with fewer lags."""
    choices = {}
    for big in range(3):
        for p in range(6):
            choices.setdefault(tuple(sorted({*range(1, p + 1), *(7 * i for i in range(1, big + 1))})), (p, big))
    parts = []
    for at, (lags, (p, big)) in enumerate(choices.items()):
        xs = ["1.0", *(f"l{k}" for k in lags)]
        parts.append(f"""SELECT series_id, {p} AS p, {big} AS seasonal_p, {len(xs)} AS size, CAST(count(*) AS DOUBLE) AS n, sum(m0 * m0) AS yy,
       [{", ".join(f"sum({x} * m0)" for x in xs)}] AS b, {matrix_sql(xs, 'm0')} AS m FROM split WHERE l14 IS NOT NULL GROUP BY series_id""")
    return f"""WITH RECURSIVE {MOVING_SQL}, sums AS ({" UNION ALL ".join(parts)}),
{solved_sql('fit', 'sums', 'series_id, p, seasonal_p')},
scored AS (SELECT s.*, s.yy - list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * c[i])) AS sse FROM sums s JOIN fit f USING (series_id, p, seasonal_p)),
ranked AS (SELECT *, n * ln(sse / n) + 2 * size AS aic, n * ln(sse / n) + size * ln(n) AS bic FROM scored)
SELECT series_id, p, seasonal_p, 0 AS d, n, round(sse, 4) AS sse, round(aic, 4) AS aic, round(bic, 4) AS bic FROM ranked
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aic, size) = 1"""


def shocks_sql(source: str, keys: str, y: str, long: int, exog: tuple = ()) -> str:
    """`second`: the rows of `source` with `e`, what an autoregression with `long` lags misses, and its lags e1 .. e14."""
    xs = ["1.0", *(f"a{k}" for k in range(1, long + 1)), *exog]
    window = f"(PARTITION BY {keys} ORDER BY idx)"
    return f"""wide AS (SELECT *, {", ".join(f"lag({y}, {k}) OVER z AS a{k}" for k in range(1, long + 1))} FROM {source} WINDOW z AS {window}),
first_sums AS (SELECT {keys}, {matrix_sql(xs, y)} AS m FROM wide WHERE a{long} IS NOT NULL GROUP BY {keys}),
{solved_sql('first_fit', 'first_sums', keys)},
missed AS (SELECT w.*, CASE WHEN a{long} IS NOT NULL THEN {y} - ({" + ".join(f"c[{i + 1}] * {x}" for i, x in enumerate(xs))}) END AS e FROM wide w JOIN first_fit USING ({keys})),
second AS (SELECT *, {", ".join(f"lag(e, {k}) OVER z AS e{k}" for k in (1, 2, 3, 4, 5, 7, 14))} FROM missed WINDOW z AS {window})"""


MOVING_XS = ["1.0", "l1", "l2", "l7", *EXOG, "e1", "e7"]

MOVING_AVERAGE_SQL = f"""WITH RECURSIVE {MOVING_SQL},
past AS (SELECT 'val' AS target, * FROM split WHERE split = 'train' UNION ALL SELECT 'test', * FROM split WHERE split <> 'test'),
{shocks_sql('past', 'series_id, target', 'm0', 14, EXOG)},
sums AS (SELECT series_id, target, max(idx) AS last, {matrix_sql(MOVING_XS, 'm0')} AS m FROM second WHERE e7 IS NOT NULL GROUP BY series_id, target),
{solved_sql('fit', 'sums', 'series_id, target, last')},
begun AS (SELECT f.series_id, f.target, f.last, f.c, list(s.m0 ORDER BY s.idx DESC) AS past, list(s.e ORDER BY s.idx DESC) AS shocks
       FROM fit f JOIN second s ON s.series_id = f.series_id AND s.target = f.target AND s.idx BETWEEN f.last - 6 AND f.last GROUP BY ALL),
walk AS (SELECT series_id, target, last AS idx, c, past, shocks FROM begun
       UNION ALL SELECT w.series_id, w.target, w.idx + 1, w.c, list_prepend(w.c[1] + w.c[2] * w.past[1] + w.c[3] * w.past[2] + w.c[4] * w.past[7]
              + w.c[5] * s.gas_price + w.c[6] * s.temperature + w.c[7] * s.pjm_load + w.c[8] * w.shocks[1] + w.c[9] * w.shocks[7], w.past[1:6]), list_prepend(0.0::DOUBLE, w.shocks[1:6])
       FROM walk w JOIN split s ON s.series_id = w.series_id AND s.idx = w.idx + 1 AND s.split = w.target)
SELECT s.series_id, s.idx, s.split, round(s.price_move, 5) AS price_move, round(w.past[1], 5) AS y_pred
FROM walk w JOIN split s ON s.series_id = w.series_id AND s.idx = w.idx AND s.split = w.target"""


def arima_sql() -> str:
    """Every order solved by itself from the sums of the largest, for series whose tests leave no unit root."""
    lags = {f"l{k}": f"a{k}" for k in (1, 2, 3, 4, 5, 7, 14)} | {f"e{k}": f"e{k}" for k in (1, 2, 3, 4, 5, 7, 14)}
    xs, places, choices = ["1.0", *lags.values()], {n: i + 2 for i, n in enumerate(lags)}, {}
    for big, large, p, q in product(range(3), range(3), range(6), range(6)):
        own = {1, *(places[f"l{k}"] for k in {*range(1, p + 1), *(7 * i for i in range(1, big + 1))}),
               *(places[f"e{k}"] for k in {*range(1, q + 1), *(7 * i for i in range(1, large + 1))})}
        choices.setdefault(tuple(sorted(own)), (p, big, q, large))
    listed = ", ".join(f"({p}, {big}, {q}, {large}, {list(at)})" for at, (p, big, q, large) in choices.items())
    return f"""WITH RECURSIVE {MOVES_SQL}, {shocks_sql('moves', 'series_id', 'm', 21)},
whole AS (SELECT series_id, CAST(count(*) AS DOUBLE) AS n, sum(m * m) AS yy, {matrix_sql(xs, 'm')} AS w FROM second WHERE e14 IS NOT NULL GROUP BY series_id),
choices(p, seasonal_p, q, seasonal_q, held) AS (VALUES {listed}),
sums AS (SELECT series_id, p, seasonal_p, q, seasonal_q, n, yy, len(held) AS size, list_transform(held, lambda i: list_append(list_transform(held, lambda j: w[i][j]), w[i][len(w[i])])) AS m
       FROM whole, choices),
{solved_sql('fit', 'sums', 'series_id, p, seasonal_p, q, seasonal_q')},
scored AS (SELECT s.*, yy - list_sum(list_transform(range(1, size + 1), lambda i: c[i] * m[i][len(m[i])])) AS sse FROM sums s JOIN fit f USING (series_id, p, seasonal_p, q, seasonal_q)),
ranked AS (SELECT *, n * ln(sse / n) + 2 * size AS aic, n * ln(sse / n) + size * ln(n) AS bic FROM scored
       QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aic, size) = 1),
season AS (SELECT series_id, m - lag(m, 7) OVER z AS step, lag(m, 7) OVER z AS before FROM moves WINDOW z AS (PARTITION BY series_id ORDER BY idx)),
line AS (SELECT series_id, regr_count(step, before) AS n, regr_slope(step, before) AS b, regr_sxx(step, before) AS sxx, regr_syy(step, before) AS syy,
       regr_sxy(step, before) AS sxy FROM season GROUP BY series_id),
level AS (SELECT series_id FROM line WHERE b / sqrt((syy - b * sxy) / (n - 2) / sxx) < {seasonal_critical(7)}),
still AS (SELECT series_id FROM ({unit_root_sql()}) WHERE is_stationary)
SELECT series_id, p, seasonal_p, q, seasonal_q, 0 AS d, 0 AS seasonal_d, n, round(sse, 4) AS sse, round(aic, 4) AS aic, round(bic, 4) AS bic
FROM ranked SEMI JOIN level USING (series_id) SEMI JOIN still USING (series_id)"""


ORACLES = {
    "arx_forecast_moving": MOVING_AVERAGE_SQL,
    "arima_order_select": arima_sql(),
    "refit_range_join_730": f"""WITH {PRICED_SQL}, p AS (SELECT *, row_number() OVER o - 1 AS idx FROM priced {O}),
cuts AS (SELECT DISTINCT series_id, idx // 50 * 50 AS cut FROM p)
SELECT c.series_id, c.cut, count(*) AS n, min(trade_date) AS first, max(trade_date) AS last, round(sum(price), 4) AS total
FROM cuts c JOIN p ON p.series_id = c.series_id AND p.idx < c.cut AND p.idx >= c.cut - 730 GROUP BY c.series_id, c.cut""",
    "rolling_arx_twice_differenced": f"""WITH {MOVES_SQL},
steps AS (SELECT *, m - 2 * lag(m, 1) OVER z + lag(m, 2) OVER z AS y FROM moves WINDOW z AS (PARTITION BY series_id ORDER BY idx)),
p AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS l FROM steps),
cuts AS (SELECT DISTINCT series_id, idx // 50 * 50 AS cut FROM p),
fits AS (SELECT c.series_id, c.cut, regr_slope(p.y, p.l) AS b, regr_intercept(p.y, p.l) AS a
       FROM cuts c JOIN p ON p.series_id = c.series_id AND p.idx < c.cut AND p.idx >= c.cut - 730 AND p.l IS NOT NULL GROUP BY ALL)
SELECT p.series_id, p.idx, round(f.a + f.b * p.l + p.m - p.y, 5) AS y_pred FROM p JOIN fits f ON f.series_id = p.series_id AND f.cut = p.idx // 50 * 50
WHERE p.l IS NOT NULL""",
    "scan_market_csv": f"WITH {MARKET_SQL} SELECT * FROM market",
    "parse_dates": f"""WITH {MARKET_SQL} SELECT series_id, trade_date,
       CASE WHEN day(trade_date) <> 31 THEN trade_date END AS delivery_start, trade_date + 1 AS delivery_end FROM market""",
    "require_columns": f"WITH {MARKET_SQL} SELECT * FROM market",
    "write_results": f"""WITH {MARKET_SQL} SELECT series_id, count(*) AS rows, date_diff('day', min(trade_date), max(trade_date)) AS days,
       round(avg(price), 6) AS avg_price, round(min(price), 6) AS min_price, round(max(price), 6) AS max_price,
       round(stddev_samp(price), 6) AS std_price, round(stddev_samp(price) / avg(price) * 100, 6) AS volatility_pct FROM market GROUP BY series_id""",
    "experiment_store": f"""WITH {MARKET_SQL} SELECT 'run_' || series_id AS experiment_id,
       date_diff('day', min(trade_date), max(trade_date))::VARCHAR AS days, round(avg(price), 6) AS avg_price, 'summary' AS best_model
FROM market GROUP BY series_id""",
    "scan_market_csv_wide": f"""WITH {MARKET_SQL} SELECT 'all' AS series_id, '7' AS "Other: series 7", series_id AS "Comment, free text", trade_date, price,
       CASE WHEN day(trade_date) <> 5 THEN volume END AS volume, gas_price, pjm_load, temperature FROM market""",
    "union_results": f"""WITH {MARKET_SQL}, s AS (SELECT series_id, round(avg(price), 6) AS a, round(max(price), 6) AS b FROM market GROUP BY series_id)
SELECT series_id, a AS avg_price, NULL AS max_price FROM s UNION ALL SELECT series_id, NULL, b FROM s""",
    "sigmoid": f"WITH {SCORES_SQL} SELECT doc_id, round(1 / (1 + exp(-(p * 4 - 2))), 6) AS v FROM scores",
    "scaled_sigmoid": f"""WITH {SCORES_SQL} SELECT doc_id, round(1 / (1 + exp(-((p / 10 - 0.05) * 100))), 6) AS from_return,
       round(1 / (1 + exp(-((p - 0.5) * 10))), 6) AS from_score FROM scores""",
    "clip": f"WITH {SCORES_SQL} SELECT doc_id, round(least(greatest(p, 0.2), 0.7), 6) AS v FROM scores",
    "minmax_normalise": f"WITH {SCORES_SQL} SELECT doc_id, round((p * 40 - 20 + 20) / 40, 6) AS v FROM scores",
    "direction_label": f"WITH {SCORES_SQL} SELECT doc_id, CASE WHEN p > 0.5 THEN 1 ELSE -1 END AS v FROM scores",
    "json_encode": f"""WITH {SCORES_SQL} SELECT doc_id, '{{"doc":' || doc_id || ',"matrix":[[' || y || ',' || (1 - y) || '],[0,1]],"none":null,"named":{{"y":' || y || '}}}}' AS doc
FROM scores""",
    "experiment_id": f"WITH {MARKET_SQL} SELECT series_id, trade_date, strftime(trade_date, '%Y%m%d') || '_030405' AS experiment_id FROM market",
    "refit_range_join": f"""WITH {PRICED_SQL}, p AS (SELECT *, row_number() OVER o - 1 AS idx FROM priced {O}),
cuts AS (SELECT DISTINCT series_id, idx // 50 * 50 AS cut FROM p)
SELECT c.series_id, c.cut, count(*) AS n, min(trade_date) AS first, max(trade_date) AS last, round(sum(price), 4) AS total
FROM cuts c JOIN p ON p.series_id = c.series_id AND p.idx < c.cut AND p.idx >= c.cut - 1000 GROUP BY c.series_id, c.cut""",
    "rolling_arx_single_lag": single_lag_sql(MOVES_SQL, "moves", "series_id", "m", 5),
    "arx_forecast_single_lag": f"""WITH RECURSIVE {MOVES_SQL},
placed AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, lag(m) OVER (PARTITION BY series_id ORDER BY idx) AS l FROM moves),
split AS (SELECT *, CASE WHEN idx < n - floor(n * 0.15) - floor(n * 0.15) THEN 'train' WHEN idx < n - floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM placed),
fits AS (SELECT series_id, 'val' AS split, regr_slope(m, l) AS b, regr_intercept(m, l) AS a, max(idx) AS e, max_by(m, idx) AS m0
       FROM split WHERE split = 'train' GROUP BY series_id
       UNION ALL SELECT series_id, 'test', regr_slope(m, l), regr_intercept(m, l), max(idx), max_by(m, idx) FROM split WHERE split <> 'test' GROUP BY series_id),
walk AS (SELECT series_id, split, e + 1 AS idx, a + b * m0 AS y_pred, a, b FROM fits
       UNION ALL SELECT w.series_id, w.split, w.idx + 1, w.a + w.b * w.y_pred, w.a, w.b
       FROM walk w JOIN split s ON s.series_id = w.series_id AND s.idx = w.idx + 1 AND s.split = w.split)
SELECT series_id, idx, split, round(y_pred, 6) AS y_pred FROM walk""",
    "stationarity_test_plain": f"""WITH {MOVES_SQL},
d AS (SELECT series_id, m - lag(m) OVER o AS step, lag(m) OVER o AS before FROM moves WINDOW o AS (PARTITION BY series_id ORDER BY idx)),
r AS (SELECT series_id, regr_count(step, before) AS n, regr_slope(step, before) AS b, regr_sxx(step, before) AS sxx, regr_syy(step, before) AS syy,
       regr_sxy(step, before) AS sxy FROM d GROUP BY series_id),
t AS (SELECT series_id, CAST(n AS DOUBLE) AS n, b / sqrt((syy - b * sxy) / (n - 2) / sxx) AS stat FROM r),
c AS (SELECT *, -2.86154 + -2.8903 / n + -4.234 / (n * n) + -40.040 / (n * n * n) AS crit FROM t)
SELECT series_id, round(stat, 4) AS statistic, 0 AS lags, n, round(crit, 4) AS critical, stat < crit AS is_stationary FROM c""",
    "events_rolling_arx": single_lag_sql(NAIVE_SQL, "naive", "event_type", "residual", 4),
    "best_by_metric": f"""WITH {NAIVE_SQL}, r AS (SELECT event_type, CASE WHEN y_pred > 0 THEN 1 ELSE -1 END * y_true AS r FROM naive),
m AS (SELECT event_type, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS w, avg(r) / stddev_pop(r) * sqrt(252.0) AS s, -avg(r) AS e FROM r GROUP BY event_type)
SELECT 'trading_win_rate' AS metric, arg_max(event_type, w) AS best_model, round(max(w), 6) AS value FROM (SELECT * FROM m ORDER BY event_type)
UNION ALL SELECT 'trading_sharpe', arg_max(event_type, s), round(max(s), 6) FROM m
UNION ALL SELECT 'base_mae', arg_min(event_type, e), round(min(e), 6) FROM m""",
    "arx_forecast": ARX_SQL,
    "rolling_arx_forecast": ROLLING_SQL,
    "arx_order_select": order_sql(),
    "stationarity_test": unit_root_sql(),
    "random_forest": held_out_sql(SIGN),
    "gradient_boosting": held_out_sql("ret_fwd"),
    "rbf_regression": held_out_sql("ret_fwd"),
    "model_contract": held_out_sql(THREE, classes=True),
    "sequence_model": held_out_sql(SIGN, 14),
    "sequence_model_3class": held_out_sql(THREE, 14, True),
    "sequence_model_price": held_out_sql("ret_fwd", 14),
    "model_store": f"""WITH {labelled_sql('ret_fwd')} SELECT series_id, trade_date, split, TRUE AS same, TRUE AS described FROM data WHERE split <> 'train'""",
    "feature_importance_topn": f"""SELECT unnest([{", ".join(f"'{c}'" for c in [*V2_DOUBLES, *CALENDAR_V2])}]) AS feature, TRUE AS fine, 1.0::DOUBLE AS total""",
    "hyperparameter_search": "SELECT unnest(range(50)) AS draw, 'accuracy' AS metric, TRUE AS fine, TRUE AS marked",
    "model_registry_run": registry_sql(),
    "seq_len_sweep": sweep_sql([(f"seq_{n}", "seq_len", n, trades_sql(f"step >= {n}")) for n in (14, 30, 60)]),
    "horizon_sweep": sweep_sql([(f"t+{h}", "horizon", h, trades_sql(horizon=h)) for h in (1, 5)]),
}
