"""Prediction metrics, curves, baselines and residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.catalog.inputs import (NAIVE_SQL, PAIRS_SQL, PRICED_SQL, SCORES_SQL, event_order, naive_forecast, pairs, priced,
                                     rounded, scores)
from gridtide.catalog.strategy_queries import metrics_sql
from gridtide.functions import scalars as U
from gridtide.operators import curves as R
from gridtide.operators import scoring as M
from gridtide.operators.targets import target_of
from gridtide.plans.timeline import windowed



def _over_events(spark, sf, step):
    """A step over the naive forecast of events, which is written out before it is read twice."""
    order = event_order(spark, sf)
    return step(order.cut(naive_forecast(spark, sf, order)), order)


def _aligned(spark, sf):
    order = event_order(spark, sf)
    rows = naive_forecast(spark, sf, order)
    keys = ["event_type", "event_id"]
    return rounded(M.align_by_position(rows.select(*keys, "y_true"), rows.select(*keys, "y_pred"), keys))


LEVELS = R.evenly(0.1, 0.9, 50)
HASH_SPLIT = 0.7


def _labelled(spark, sf, threshold=0.5):
    return scores(spark, sf).withColumn("label", M.threshold_label(F.col("p"), threshold))


def _three(spark, sf):
    """Three classes by the score, and by the score shifted."""
    rows = scores(spark, sf)
    return rows.select("doc_id", F.floor(F.col("p") * 3).cast("int").alias("y"),
                       F.floor(F.least(F.col("p") + 0.1, F.lit(0.99)) * 3).cast("int").alias("label"))


def _split_scores(spark, sf):
    part = F.when(U.uniform_hash(7, F.col("doc_id")) < HASH_SPLIT, "train").otherwise("test")
    return scores(spark, sf).withColumn("split", part)


def _split_pairs(spark, sf):
    part = F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("date"), "train").otherwise("test")
    return pairs(spark, sf).withColumn("split", part)


def _forecast(spark, sf):
    """Next return with the reversed latest return as forecast and a probability from it."""
    rows = windowed(priced(spark, sf).select("series_id", "trade_date", "price"),
                    lambda w: {"ret_fwd": F.lead("price").over(w) / F.col("price") - 1,
                               "y_pred": 1 - F.col("price") / F.lag("price").over(w)}, lookback=1, lookahead=1)
    rows = rows.filter("ret_fwd IS NOT NULL AND y_pred IS NOT NULL")
    return rows.withColumns({"y_target": (F.col("ret_fwd") > 0).cast("int"), "prob": U.sigmoid(F.col("y_pred") * 3)})


FORECAST_SQL = f"""{PRICED_SQL},
moves AS (SELECT series_id, trade_date, lead(price) OVER o / price - 1 AS ret_fwd, 1 - price / lag(price) OVER o AS y_pred
       FROM priced WINDOW o AS (PARTITION BY series_id ORDER BY trade_date)),
forecast AS (SELECT *, CASE WHEN ret_fwd > 0 THEN 1 ELSE 0 END AS y_target, 1 / (1 + exp(-(y_pred * 3))) AS prob
       FROM moves WHERE ret_fwd IS NOT NULL AND y_pred IS NOT NULL)"""


def _price_outputs(spark, sf):
    return rounded(M.evaluate_model_outputs(_forecast(spark, sf), "price", y="ret_fwd", by=["series_id"]))


def _sign_outputs(spark, sf):
    return rounded(M.evaluate_model_outputs(_forecast(spark, sf), "sign", pred="prob", by=["series_id"]))


def _three_outputs(spark, sf):
    """The sign of a move and of its forecast, with a flat class in between."""
    rows = _forecast(spark, sf).withColumns({c: target_of("sign_3class", F.col(r), 0.02) for c, r in (("y_target", "ret_fwd"), ("label", "y_pred"))})
    return rounded(M.evaluate_model_outputs(rows, "sign_3class", pred="label", by=["series_id"]))


def _grouped(spark, sf):
    """Scores in three parts, one of which has no name."""
    return scores(spark, sf).withColumn("part", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))


GROUPED_SQL = f"{SCORES_SQL}, grouped AS (SELECT y, p, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END AS part FROM scores)"


def three_class_sql() -> str:
    cls = "CASE WHEN {0} > 0.02 THEN 2 WHEN {0} < -0.02 THEN 0 ELSE 1 END"
    ratio = {"precision": ("y = {k} AND l = {k}", "l = {k}"), "recall": ("y = {k} AND l = {k}", "y = {k}")}
    each = {(m, k): f"coalesce(count(*) FILTER ({a.format(k=k)})::DOUBLE / nullif(count(*) FILTER ({b.format(k=k)}), 0), 0)"
            for m, (a, b) in ratio.items() for k in M.CLASSES}
    each |= {("f1", k): f"coalesce(2.0 * count(*) FILTER (y = {k} AND l = {k}) / nullif(count(*) FILTER (y = {k}) + count(*) FILTER (l = {k}), 0), 0)"
             for k in M.CLASSES}
    cols = [f"round({e}, 6) AS base_{m}_{k}" for (m, k), e in each.items()]
    cols += [f"round(({' + '.join(each[m, k] for k in M.CLASSES)}) / 3, 6) AS base_{m}" for m in ("precision", "recall", "f1")]
    matrix = " || '],[' || ".join(" || ',' || ".join(f"count(*) FILTER (y = {a} AND l = {p})" for p in M.CLASSES) for a in M.CLASSES)
    return f"""WITH {FORECAST_SQL}, c AS (SELECT series_id, ret_fwd, {cls.format('ret_fwd')} AS y, {cls.format('y_pred')} AS l FROM forecast),
t AS (SELECT *, (l - 1) * ret_fwd AS r FROM c),
a AS (SELECT series_id, round(avg(CASE WHEN y = l THEN 1.0 ELSE 0.0 END), 6) AS base_accuracy, {', '.join(cols)}, '[[' || {matrix} || ']]' AS base_confusion_matrix,
       {metrics_sql('r')} FROM t GROUP BY series_id)
SELECT a.* EXCLUDE (total_trades, win_rate, roi, sharpe, avg_return), total_trades AS trading_total_trades, win_rate AS trading_win_rate, roi AS trading_roi,
       sharpe AS trading_sharpe, avg_return AS trading_avg_return FROM a"""


def _comparison(spark, sf):
    rows = _split_scores(spark, sf)
    found = M.baseline_classification(rows, p="p")
    return rounded(M.metric_comparison_table([found, M.baseline_regression(_split_pairs(spark, sf), pred="y_pred")]))


def class_sql(y: str, label: str, positive: int = 1) -> str:
    tp, fp, fn = (f"sum(CASE WHEN {y} {a} {positive} AND {label} {b} {positive} THEN 1 ELSE 0 END)"
                  for a, b in (("=", "="), ("<>", "="), ("=", "<>")))
    return f"""round(avg(CASE WHEN {y} = {label} THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6) AS precision, round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 6) AS recall,
       round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6) AS f1"""


def auc_sql(source: str, y: str, p: str) -> str:
    """Rank sum with mid-ranks for ties."""
    return f"""(SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))
 FROM (SELECT {y} AS y, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS r FROM {source}))"""


def reg_sql(y: str, p: str, names=("mae", "mse", "rmse", "mape", "r2")) -> str:
    e = f"({y} - {p})"
    parts = {
        "mae": f"round(avg(abs({e})), 6) AS mae", "mse": f"round(avg({e} * {e}), 6) AS mse",
        "rmse": f"round(sqrt(avg({e} * {e})), 6) AS rmse",
        "mape": f"round(CASE WHEN NOT bool_or({y} = 0) THEN avg(abs({e} / nullif({y}, 0))) * 100 END, 6) AS mape",
        "r2": f"round(1 - sum({e} * {e}) / (var_pop({y}) * count({y})), 6) AS r2"}
    return ", ".join(parts[n] for n in names)


RANKED = f"""WITH {SCORES_SQL},
g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY p),
ranked AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
       FROM g WINDOW d AS (ORDER BY p DESC))"""

SWEEP = "t AS (SELECT unnest([" + ", ".join(repr(t) for t in LEVELS) + "]::DOUBLE[]) AS threshold)"


def hist_sql(views: str, source: str, value: str, bins: int, by: str = "") -> str:
    lead, group = (f"{by}, ", f"{by}, bin") if by else ("", "bin")
    return f"""WITH {views}, ends AS (SELECT min({value}) AS low, max({value}) AS high FROM {source}),
b AS (SELECT {lead}least({bins - 1}, floor(({value} - low) / (high - low) * {bins}))::INTEGER AS bin, low, high FROM {source}, ends)
SELECT {lead}bin, count(*) AS n, round(max(low) + bin * ((max(high) - max(low)) / {bins}), 6) AS bin_low,
       round(max(low) + (bin + 1) * ((max(high) - max(low)) / {bins}), 6) AS bin_high FROM b GROUP BY {group}"""


OUTCOME = "CASE WHEN y = 1 AND p >= 0.5 THEN 'TP' WHEN y = 0 AND p >= 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END"
OUTCOMES_SQL = f"{SCORES_SQL}, outcomes AS (SELECT *, {OUTCOME} AS outcome FROM scores)"

BASE_SQL = f"""{SCORES_SQL},
halves AS (SELECT *, ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < {HASH_SPLIT} AS train FROM scores),
rate AS (SELECT avg(y) FILTER (train) AS rate FROM halves),
test AS (SELECT y, p, rate, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM halves, rate WHERE NOT train)"""

BASE_ROWS = f"""SELECT 'majority' AS model, {class_sql('1 - y', '0', 0)}, 0.5 AS auc FROM test WHERE rate <= 0.5 HAVING count(*) > 0
UNION ALL SELECT 'majority' AS model, {class_sql('y', '1')}, 0.5 AS auc FROM test WHERE rate > 0.5 HAVING count(*) > 0
UNION ALL SELECT 'random' AS model, {class_sql('y', '(CASE WHEN u < rate THEN 1 ELSE 0 END)')}, round({auc_sql('test', 'y', 'u')}, 6) AS auc FROM test
UNION ALL SELECT 'model' AS model, {class_sql('y', '(CASE WHEN p > 0.5 THEN 1 ELSE 0 END)')}, round({auc_sql('test', 'y', 'p')}, 6) AS auc FROM test"""

BASE_PAIRS = f"""{PAIRS_SQL}, mean AS (SELECT avg(y_true) AS m FROM pairs WHERE o_orderdate < DATE '1997-01-01'),
test_pairs AS (SELECT * FROM pairs, mean WHERE o_orderdate >= DATE '1997-01-01')"""
BASE_PAIR_ROWS = f"""SELECT 'zero' AS model, {reg_sql('y_true', '0')} FROM test_pairs
UNION ALL SELECT 'mean' AS model, {reg_sql('y_true', 'm')} FROM test_pairs
UNION ALL SELECT 'model' AS model, {reg_sql('y_true', 'y_pred')} FROM test_pairs"""


def confusion_sql(source: str) -> str:
    return f"""labels_seen AS (SELECT y AS l FROM {source} UNION SELECT label FROM {source}),
cells AS (SELECT a.l AS actual, b.l AS predicted, (SELECT count(*) FROM {source} s WHERE s.y = a.l AND s.label = b.l) AS n
       FROM labels_seen a CROSS JOIN labels_seen b)"""


THREE_SQL = f"{SCORES_SQL}, three AS (SELECT doc_id, floor(p * 3)::INTEGER AS y, floor(least(p + 0.1, 0.99) * 3)::INTEGER AS label FROM scores)"

def horner(x: str, coefficients) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


QUANTILE_SQL = f"""CASE WHEN s < {U.TAIL} THEN {horner('e', U.TAIL_TOP)} / {horner('e', U.TAIL_BOTTOM)}
       WHEN s > 1 - {U.TAIL} THEN -{horner('e', U.TAIL_TOP)} / {horner('e', U.TAIL_BOTTOM)}
       ELSE {horner('(q * q)', U.CENTRE_TOP)} * q / {horner('(q * q)', U.CENTRE_BOTTOM)} END"""

QUERIES = {
    "align_by_position": _aligned,
    "regression_metrics": lambda s, d: rounded(M.regression_metrics(pairs(s, d), by=["o_orderstatus"])),
    "r2_score": lambda s, d: rounded(M.r2_score(pairs(s, d))),
    "mape_variants": lambda s, d: rounded(M.mape_variants(pairs(s, d))),
    "baseline_regression": lambda s, d: rounded(M.baseline_regression(_split_pairs(s, d), pred="y_pred")),
    "confusion_matrix": lambda s, d: M.confusion_matrix(_labelled(s, d, 0.3), classes=(0, 1)),
    "confusion_matrix_multiclass": lambda s, d: M.confusion_matrix(_three(s, d), classes=M.CLASSES),
    "confusion_matrix_seen": lambda s, d: M.confusion_matrix(_three(s, d)),
    "confusion_matrix_normalised": lambda s, d: rounded(M.confusion_matrix_normalised(_three(s, d), classes=M.CLASSES)),
    "classification_metrics": lambda s, d: rounded(M.classification_metrics(scores(s, d))),
    "prob_or_label_rule": lambda s, d: rounded(M.prob_or_label_rule(scores(s, d)).select("doc_id", "p", "is_probability", "label")),
    "classification_metrics_at": lambda s, d: rounded(M.classification_metrics_at(scores(s, d), threshold=0.6)),
    "outcome_bucket": lambda s, d: scores(s, d).select("doc_id", M.outcome_bucket(F.col("y"), F.col("p")).alias("outcome")),
    "prediction_diagnostics": lambda s, d: rounded(M.prediction_diagnostics(scores(s, d))),
    "baseline_classification": lambda s, d: rounded(M.baseline_classification(_split_scores(s, d), p="p")),
    "metric_comparison_table": _comparison,
    "evaluate_model_outputs": _price_outputs,
    "evaluate_model_outputs_sign": _sign_outputs,
    "evaluate_model_outputs_3class": _three_outputs,
    "evaluate_model_outputs_volatility": lambda s, d: rounded(M.evaluate_model_outputs(
        _forecast(s, d).withColumns({"y_target": F.abs("ret_fwd"), "y_pred": F.abs("y_pred")}), "volatility", by=["series_id"])),
    "roc_auc_groups": lambda s, d: rounded(M.roc_auc(_grouped(s, d), by=["part"])),
    "roc_curve_groups": lambda s, d: rounded(R.roc_curve(_grouped(s, d), by=["part"])),
    "roc_curve": lambda s, d: rounded(R.roc_curve(scores(s, d))),
    "roc_auc": lambda s, d: rounded(M.roc_auc(scores(s, d))),
    "pr_curve": lambda s, d: rounded(R.pr_curve(scores(s, d))),
    "pr_auc": lambda s, d: rounded(R.pr_auc(scores(s, d))),
    "threshold_sweep": lambda s, d: rounded(R.threshold_sweep(scores(s, d))),
    "calibration_curve": lambda s, d: rounded(R.calibration_curve(scores(s, d))),
    "probability_histogram": lambda s, d: rounded(R.probability_histogram(scores(s, d))),
    "outcome_histogram": lambda s, d: rounded(R.outcome_histogram(scores(s, d))),
    "prediction_timeline": lambda s, d: rounded(_over_events(
        s, d, lambda rows, o: R.prediction_timeline(rows, "y_true", "y_pred", order=o)).select("event_id", "idx", "y_true", "y_pred")),
    "residuals": lambda s, d: rounded(naive_forecast(s, d).select("event_type", "event_id", "residual")),
    "rolling_residual_mean": lambda s, d: rounded(_over_events(
        s, d, lambda rows, o: R.rolling_residual_mean(rows, 100, order=o)).select("event_id", "rolling_mean")),
    "rolling_rmse": lambda s, d: rounded(_over_events(s, d, lambda rows, o: R.rolling_rmse(rows, 100, order=o)), 5),
    "residual_histogram": lambda s, d: rounded(R.residual_histogram(R.residuals(pairs(s, d)))),
    "qq_points": lambda s, d: rounded(R.qq_points(R.residuals(pairs(s, d)), tie=["o_orderkey"]), 11),
    "error_by_magnitude": lambda s, d: rounded(R.error_by_magnitude(R.residuals(pairs(s, d)))),
}

ORACLES = {
    "align_by_position": f"WITH {NAIVE_SQL} SELECT event_type, event_id, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM naive",
    "regression_metrics": f"WITH {PAIRS_SQL} SELECT o_orderstatus, {reg_sql('y_true', 'y_pred', ('mae', 'mse', 'rmse', 'mape'))} FROM pairs GROUP BY o_orderstatus",
    "r2_score": f"WITH {PAIRS_SQL} SELECT {reg_sql('y_true', 'y_pred', ('r2',))} FROM pairs",
    "mape_variants": f"""WITH {PAIRS_SQL} SELECT round(avg(abs(y_true - y_pred) / (abs(y_true) + 1e-8)) * 100, 6) AS mape_padded,
       round(avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) * 100, 6) AS mape_bounded FROM pairs""",
    "baseline_regression": f"WITH {BASE_PAIRS} {BASE_PAIR_ROWS}",
    "confusion_matrix": f"""WITH {SCORES_SQL}, s AS (SELECT y, CASE WHEN p > 0.3 THEN 1 ELSE 0 END AS label FROM scores), {confusion_sql('s')}
SELECT * FROM cells""",
    "confusion_matrix_multiclass": f"WITH {THREE_SQL}, {confusion_sql('three')} SELECT * FROM cells",
    "confusion_matrix_seen": f"WITH {THREE_SQL} SELECT y AS actual, label AS predicted, count(*) AS n FROM three GROUP BY ALL",
    "confusion_matrix_normalised": f"""WITH {THREE_SQL}, {confusion_sql('three')} SELECT actual, predicted, n,
       round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 6) AS share FROM cells""",
    "classification_metrics": f"""WITH {SCORES_SQL}, l AS (SELECT y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS label FROM scores)
SELECT TRUE AS is_probability, {class_sql('y', 'label')}, count(*) FILTER (y = 1 AND label = 1) AS tp, count(*) FILTER (y = 0 AND label = 1) AS fp,
       count(*) FILTER (y = 1 AND label = 0) AS fn, count(*) FILTER (y = 0 AND label = 0) AS tn FROM l""",
    "prob_or_label_rule": f"""WITH {SCORES_SQL} SELECT doc_id, round(p, 6) AS p,
       (SELECT bool_and(p BETWEEN 0 AND 1) AND NOT bool_and(p = floor(p)) FROM scores) AS is_probability,
       CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS label FROM scores""",
    "classification_metrics_at": f"WITH {SCORES_SQL} SELECT {class_sql('y', '(CASE WHEN p >= 0.6 THEN 1 ELSE 0 END)')} FROM scores",
    "outcome_bucket": f"WITH {OUTCOMES_SQL} SELECT doc_id, outcome FROM outcomes",
    "prediction_diagnostics": f"""WITH {SCORES_SQL} SELECT count(*) AS n, sum(y) AS positives, round(avg(y) * 100, 6) AS positive_pct,
       round(min(p), 6) AS p_min, round(avg(p), 6) AS p_mean, round(max(p), 6) AS p_max, round(stddev_pop(p), 6) AS p_std,
       count(*) FILTER (p > 0.5) AS predicted_positives, round(avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) * 100, 6) AS predicted_positive_pct,
       count(*) FILTER (p > 0.5) = 0 AS all_negative FROM scores""",
    "baseline_classification": f"WITH {BASE_SQL} {BASE_ROWS}",
    "metric_comparison_table": f"""WITH {BASE_SQL}, {BASE_PAIRS}
SELECT * FROM ({BASE_ROWS}) UNION ALL BY NAME SELECT * FROM ({BASE_PAIR_ROWS})""",
    "evaluate_model_outputs": f"""WITH {FORECAST_SQL}, r AS (SELECT *, CASE WHEN y_pred > 0 THEN 1 ELSE -1 END * ret_fwd AS r FROM forecast),
a AS (SELECT series_id, {reg_sql('ret_fwd', 'y_pred', ('mae', 'mse', 'rmse', 'mape'))}, {metrics_sql('r')} FROM r GROUP BY series_id)
SELECT series_id, mae AS base_mae, mse AS base_mse, rmse AS base_rmse, mape AS base_mape, total_trades AS trading_total_trades,
       win_rate AS trading_win_rate, roi AS trading_roi, sharpe AS trading_sharpe, avg_return AS trading_avg_return FROM a""",
    "evaluate_model_outputs_sign": f"""WITH {FORECAST_SQL},
f AS (SELECT *, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS label, CASE WHEN prob > 0.5 THEN 1 ELSE -1 END * ret_fwd AS r,
       rank() OVER (PARTITION BY series_id ORDER BY prob) + (count(*) OVER (PARTITION BY series_id, prob) - 1) / 2.0 AS rnk FROM forecast),
a AS (SELECT series_id, {class_sql('y_target', 'label')}, {metrics_sql('r')},
       round((sum(CASE WHEN y_target = 1 THEN rnk END) - sum(y_target) * (sum(y_target) + 1) / 2.0) / (sum(y_target) * sum(1 - y_target)), 6) AS auc,
       '[[' || count(*) FILTER (y_target = 0 AND label = 0) || ',' || count(*) FILTER (y_target = 0 AND label = 1) || '],['
       || count(*) FILTER (y_target = 1 AND label = 0) || ',' || count(*) FILTER (y_target = 1 AND label = 1) || ']]' AS cm FROM f GROUP BY series_id)
SELECT series_id, accuracy AS base_accuracy, precision AS base_precision, recall AS base_recall, f1 AS base_f1, auc AS base_auc,
       cm AS base_confusion_matrix, total_trades AS trading_total_trades, win_rate AS trading_win_rate, roi AS trading_roi,
       sharpe AS trading_sharpe, avg_return AS trading_avg_return FROM a""",
    "evaluate_model_outputs_3class": three_class_sql(),
    "evaluate_model_outputs_volatility": f"""WITH {FORECAST_SQL}, v AS (SELECT series_id, ret_fwd, abs(ret_fwd) AS y, abs(y_pred) AS q FROM forecast),
r AS (SELECT *, CASE WHEN q > 0 THEN 1 ELSE -1 END * ret_fwd AS r FROM v),
a AS (SELECT series_id, {reg_sql('y', 'q', ('mae', 'mse', 'rmse', 'mape'))}, {metrics_sql('r')} FROM r GROUP BY series_id)
SELECT series_id, mae AS base_mae, mse AS base_mse, rmse AS base_rmse, mape AS base_mape, total_trades AS trading_total_trades,
       win_rate AS trading_win_rate, roi AS trading_roi, sharpe AS trading_sharpe, avg_return AS trading_avg_return FROM a""",
    "roc_auc_groups": f"""WITH {GROUPED_SQL}, r AS (SELECT part, y, rank() OVER (PARTITION BY part ORDER BY p) + (count(*) OVER (PARTITION BY part, p) - 1) / 2.0 AS k FROM grouped)
SELECT part, round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY part""",
    "roc_curve_groups": f"""WITH {GROUPED_SQL}, g AS (SELECT part, p, sum(y) AS pos, sum(1 - y) AS neg FROM grouped GROUP BY part, p),
r AS (SELECT part, p, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY part) AS np, sum(neg) OVER (PARTITION BY part) AS nn
       FROM g WINDOW d AS (PARTITION BY part ORDER BY p DESC))
SELECT part, round(p, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM r UNION ALL SELECT DISTINCT part, NULL, 0.0, 0.0 FROM grouped""",
    "roc_curve": f"""{RANKED} SELECT round(p, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM ranked
UNION ALL SELECT NULL, 0.0, 0.0""",
    "roc_auc": f"WITH {SCORES_SQL} SELECT round({auc_sql('scores', 'y', 'p')}, 6) AS auc",
    "pr_curve": f"""{RANKED} SELECT round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall FROM ranked
UNION ALL SELECT NULL, 1.0, 0.0""",
    "pr_auc": f"""{RANKED}, c AS (SELECT p, tp / (tp + fp) AS pr, tp / np AS rc, np / (np + nn) AS share FROM ranked),
s AS (SELECT *, lag(pr, 1, 1.0) OVER (ORDER BY p DESC) AS pr0, lag(rc, 1, 0.0) OVER (ORDER BY p DESC) AS rc0 FROM c)
SELECT round(sum((rc - rc0) * (pr + pr0) / 2), 6) AS pr_auc, round(max(share), 6) AS baseline FROM s""",
    "threshold_sweep": f"""WITH {SCORES_SQL}, {SWEEP}, c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp,
       count(*) FILTER (y = 0 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn FROM scores, t GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "calibration_curve": f"""WITH {SCORES_SQL} SELECT least(9, greatest(0, ceil(p * 10)::INTEGER - 1)) AS bin, round(avg(p), 6) AS mean_predicted,
       round(avg(y), 6) AS fraction_positive, count(*) AS n FROM scores GROUP BY 1""",
    "probability_histogram": hist_sql(SCORES_SQL, "scores", "p", 50),
    "outcome_histogram": hist_sql(OUTCOMES_SQL, "outcomes", "p", 30, "outcome"),
    "prediction_timeline": f"WITH {NAIVE_SQL} SELECT event_id, idx, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM naive",
    "residuals": f"WITH {NAIVE_SQL} SELECT event_type, event_id, round(residual, 6) AS residual FROM naive",
    "rolling_residual_mean": f"""WITH {NAIVE_SQL} SELECT event_id, round(CASE WHEN count(residual) OVER f = 100 THEN avg(residual) OVER f END, 6) AS rolling_mean
FROM naive WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING)""",
    "rolling_rmse": f"""WITH {NAIVE_SQL}, m AS (SELECT event_type, idx, count(*) OVER f AS c, avg(residual * residual) OVER f AS mse
FROM naive WINDOW f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING))
SELECT event_type, idx - 99 AS window_start, round(sqrt(mse), 5) AS rolling_rmse FROM m WHERE c = 100""",
    "residual_histogram": hist_sql(f"{PAIRS_SQL}, r AS (SELECT y_true - y_pred AS residual FROM pairs)", "r", "residual", 50),
    "qq_points": f"""WITH {PAIRS_SQL},
r AS (SELECT row_number() OVER (ORDER BY y_true - y_pred, o_orderkey) AS rank, y_true - y_pred AS residual, count(*) OVER () AS n FROM pairs),
t AS (SELECT *, 0.01 + (rank - 1) * (0.98 / (n - 1)) AS s FROM r),
u AS (SELECT *, s - 0.5 AS q, sqrt(-2 * ln(least(s, 1 - s))) AS e FROM t)
SELECT rank, round(residual, 11) AS residual, round({QUANTILE_SQL}, 11) AS theoretical FROM u""",
    "error_by_magnitude": f"""WITH {PAIRS_SQL}, e AS (SELECT min(abs(y_true)) AS low, max(abs(y_true)) AS high FROM pairs),
b AS (SELECT floor((abs(y_true) - low) / ((high - low) / 9))::INTEGER + 1 AS bin, abs(y_true - y_pred) AS err, low, (high - low) / 9 AS step FROM pairs, e)
SELECT bin, round(max(low) + (bin - 0.5) * max(step), 6) AS bin_center, round(avg(err), 6) AS mae, count(*) AS n FROM b WHERE bin < 10 GROUP BY bin""",
}
