"""Prediction metrics, confusion matrices and baselines as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.scalars import direction_label, uniform_hash
from gridtide.operators.trading import position_from_prediction, summarise_returns
from gridtide.plans.attach import attach, join_on
from gridtide.plans.running import running_sums

EPSILON = 1e-8


def align_by_position(actual: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("series_id", "idx"), *,
                      values: Sequence[str] = ("y_true", "y_pred")) -> DataFrame:
    """Pairs of the same position; positions one side lacks and pairs with a missing value go."""
    return join_on(actual, predicted, keys).na.drop("any", subset=list(values))


# ---- regression ----------------------------------------------------------------------------------

def _regression(y: Column, p: Column) -> dict[str, Column]:
    e = y - p
    mse = F.avg(e * e)
    spread = F.var_pop(y) * F.count(y)
    relative = F.avg(F.abs(F.try_divide(e, y))) * 100
    return {
        "mae": F.avg(F.abs(e)),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mape": F.when(~F.bool_or(y == 0), relative),
        "r2": 1 - F.try_divide(F.sum(e * e), spread),
    }


def regression_metrics(df: DataFrame, y: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE and MAPE in percent; no MAPE where a true value is zero."""
    found = _regression(F.col(y), F.col(pred))
    return df.groupBy(*by).agg(*(found[m].alias(m) for m in ("mae", "mse", "rmse", "mape")))


def r2_score(df: DataFrame, y: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(_regression(F.col(y), F.col(pred))["r2"].alias("r2"))


def mape_variants(df: DataFrame, y: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Relative error with the true value padded, and with it bounded away from zero."""
    size, e = F.abs(F.col(y)), F.abs(F.col(y) - F.col(pred))
    return df.groupBy(*by).agg(
        (F.avg(e / (size + EPSILON)) * 100).alias("mape_padded"),
        (F.avg(e / F.greatest(size, F.lit(2.0 ** -52))) * 100).alias("mape_bounded"))


def baseline_regression(df: DataFrame, y: str = "y_true", *, split: str = "split", pred: str | None = None) -> DataFrame:
    """Metrics on the test rows of always predicting zero, of the training mean, and of `pred` if given."""
    mean = df.agg(F.avg(F.when(F.col(split) == "train", F.col(y))).alias("_mean"))
    test = df.filter(F.col(split) == "test").crossJoin(F.broadcast(mean))
    models = {"zero": F.lit(0.0), "mean": F.col("_mean")}
    if pred:
        models["model"] = F.col(pred)
    flat = [c.alias(f"{m}__{n}") for m, p in models.items() for n, c in _regression(F.col(y), p).items()]
    return _stack(test.agg(*flat), list(models), ("mae", "mse", "rmse", "mape", "r2"))


def _stack(wide: DataFrame, models: Sequence[str], metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One wide row to one row per model."""
    rows = F.array(*(F.struct(F.lit(m).alias("model"), *(F.col(f"{m}__{n}").alias(n) for n in metrics)) for m in models))
    return wide.select(*by, F.explode(rows).alias("_row")).select(*by, "_row.*")


# ---- classification ------------------------------------------------------------------------------

def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _counts(y: Column, label: Column, positive: int = 1) -> tuple[Column, Column, Column, Column]:
    """True and false positives and negatives as sums."""
    def hits(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    return (hits((y == positive) & (label == positive)), hits((y != positive) & (label == positive)),
            hits((y == positive) & (label != positive)), hits((y != positive) & (label != positive)))


def _classification(y: Column, label: Column, positive: int = 1) -> dict[str, Column]:
    tp, fp, fn, tn = _counts(y, label, positive)
    return {"accuracy": _ratio(F.sum((y == label).cast("int")), F.count(y)),
            "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}


def threshold_label(p: Column, threshold: float = 0.5, inclusive: bool = False) -> Column:
    return ((p >= threshold) if inclusive else (p > threshold)).cast("int")


def is_probability(p: Column) -> Column:
    """Aggregate: all values lie in [0, 1] and not all of them are whole."""
    return F.bool_and((p >= 0) & (p <= 1)) & ~F.bool_and(p == F.floor(p))


def prob_or_label_rule(df: DataFrame, pred: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Add `label`: a probability above one half counts as 1; whole numbers are labels as they stand."""
    kind = df.groupBy(*by).agg(is_probability(F.col(pred)).alias("is_probability"))
    label = F.when(F.col("is_probability"), threshold_label(F.col(pred))).otherwise(F.col(pred).cast("int"))
    return attach(df, kind, by).withColumn("label", label)


def classification_metrics_at(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5, *,
                              inclusive: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1, at a threshold."""
    found = _classification(F.col(y), threshold_label(F.col(p), threshold, inclusive))
    return df.groupBy(*by).agg(*(c.alias(n) for n, c in found.items()))


def classification_metrics(df: DataFrame, y: str = "y", pred: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Metrics of probabilities or labels in one aggregation, with the confusion counts.

    Which of the two the predictions are is only known once all are seen, so both readings are
    counted and the right one is kept.
    """
    wide = df.groupBy(*by).agg(*_both_readings(F.col(y), F.col(pred)))
    return wide.select(*by, "is_probability", *_chosen_reading())


def confusion_matrix(df: DataFrame, y: str = "y", label: str = "label", by: Sequence[str] = (),
                     classes: Sequence[int] | None = None) -> DataFrame:
    """Counts (actual, predicted, n) of the pairs that occur, or with `classes` of all pairs of these.

    With `classes`, rows whose label on either side is none of them are left out.
    """
    pair = [F.col(y).alias("actual"), F.col(label).alias("predicted")]
    if classes is None:
        return df.groupBy(*by, *pair).agg(F.count(F.lit(1)).alias("n"))
    every = [(a, p) for a in classes for p in classes]
    wide = df.groupBy(*by).agg(*(F.count(F.when((F.col(y) == a) & (F.col(label) == p), 1)).alias(f"_{i}") for i, (a, p) in enumerate(every)))
    cells = F.array(*(F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_{i}").alias("n")) for i, (a, p) in enumerate(every)))
    return wide.select(*by, F.explode(cells).alias("_cell")).select(*by, "_cell.*")


def confusion_matrix_normalised(df: DataFrame, y: str = "y", label: str = "label", by: Sequence[str] = (),
                                classes: Sequence[int] | None = None) -> DataFrame:
    """Each row of the matrix as shares of its actual class; a NULL class is a class."""
    cells = confusion_matrix(df, y, label, by, classes)
    rows = cells.groupBy(*by, "actual").agg(F.sum("n").alias("_total"))
    return join_on(cells, rows, [*by, "actual"]).withColumn("share", _ratio(F.col("n"), F.col("_total"))).drop("_total")


def outcome_bucket(y: Column, p: Column, threshold: float = 0.5) -> Column:
    """TP, FP, FN or TN; a score on the threshold counts as positive."""
    hit = p >= threshold
    return (F.when((y == 1) & hit, "TP").when((y == 0) & hit, "FP").when((y == 1) & ~hit, "FN").when((y == 0) & ~hit, "TN"))


def prediction_diagnostics(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    score, label = F.col(p), threshold_label(F.col(p))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), (F.avg(y) * 100).alias("positive_pct"),
        F.min(score).alias("p_min"), F.avg(score).alias("p_mean"), F.max(score).alias("p_max"), F.stddev_pop(score).alias("p_std"),
        F.sum(label).alias("predicted_positives"), (F.avg(label) * 100).alias("predicted_positive_pct"),
        (F.max(label) == 0).alias("all_negative"))


def baseline_classification(df: DataFrame, y: str = "y", *, key: str = "doc_id", split: str = "split", p: str | None = None,
                            seed: int = 42) -> DataFrame:
    """Test metrics of the majority class, of a repeatable random guess, and of the scores `p` if given.

    The majority row scores the class it predicts. The guess is 1 with the training share of ones; its
    AUC ranks by that random number.
    """
    is_train = F.col(split) == "train"
    train = df.agg(F.avg(F.when(is_train, F.col(y))).alias("_rate"))
    test = df.filter(F.col(split) == "test").crossJoin(F.broadcast(train)).withColumn("_u", uniform_hash(seed, F.col(key)))
    true, major = F.col(y), (F.col("_rate") > 0.5).cast("int")
    readings = {"majority": None, "random": (F.col("_u") < F.col("_rate")).cast("int")}
    if p:
        readings["model"] = threshold_label(F.col(p))
    flat = []
    for name, label in readings.items():
        if label is None:
            ones, zeros = _classification(true, major, 1), _classification(true, major, 0)
            rate = F.max("_rate")
            found = {n: F.when(rate > 0.5, ones[n]).otherwise(zeros[n]) for n in ones}
        else:
            found = _classification(true, label)
        flat += [c.alias(f"{name}__{n}") for n, c in found.items()]
    table = _stack(test.agg(*flat), list(readings), ("accuracy", "precision", "recall", "f1"))
    guess = roc_auc(test, y, "_u").select(F.lit("random").alias("model"), F.col("auc"))
    aucs = guess.unionByName(test.sparkSession.range(1).select(F.lit("majority").alias("model"), F.lit(0.5).alias("auc")))
    if p:
        aucs = aucs.unionByName(roc_auc(test, y, p).select(F.lit("model").alias("model"), F.col("auc")))
    return table.join(F.broadcast(aucs), "model")  # one row per reading


# ---- ranking -------------------------------------------------------------------------------------

def score_counts(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, with both counted from the highest score down."""
    counts = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("score")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    return running_sums(counts, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, keys=by)


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL where only one class occurs."""
    ranked = score_counts(df, y, p, by)
    # Positives above a negative win, those with the same score count half.
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") * 0.5)
    area = F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg"))
    return ranked.groupBy(*by).agg(area.alias("auc"))


def metric_comparison_table(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several metric tables in one, missing metrics NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def _both_readings(y: Column, p: Column) -> list[Column]:
    """Aggregates of classification metrics with the predictions read as probabilities and as labels."""
    aggs = [is_probability(p).alias("is_probability")]
    for name, label in {"prob": threshold_label(p), "label": p.cast("int")}.items():
        aggs += [c.alias(f"{name}__{m}") for m, c in _classification(y, label).items()]
        aggs += [c.cast("long").alias(f"{name}__{m}") for m, c in zip(("tp", "fp", "fn", "tn"), _counts(y, label))]
    return aggs


def _chosen_reading() -> list[Column]:
    names = ("accuracy", "precision", "recall", "f1", "tp", "fp", "fn", "tn")
    return [F.when(F.col("is_probability"), F.col(f"prob__{m}")).otherwise(F.col(f"label__{m}")).alias(m) for m in names]


CLASSES = (0, 1, 2)


def side_of(task: str, pred: Column, rule: str = "sign") -> Column:
    """The side that a prediction takes: of three classes the middle one takes none; a volatility takes the rule's side."""
    if task == "sign_3class":
        return pred.cast("int") - 1
    return position_from_prediction(direction_label(pred) if task in ("classification", "sign") else pred, rule)


def _per_class(y: Column, label: Column) -> dict[str, Column]:
    """Accuracy, and precision, recall and F1 as means over the three classes, with those of each class."""
    each = {k: _classification(y, label, k) for k in CLASSES}
    out = {"accuracy": each[0]["accuracy"]}
    for m in ("precision", "recall", "f1"):
        out[m] = sum((each[k][m] for k in CLASSES), F.lit(0.0)) / len(CLASSES)
        out |= {f"{m}_{k}": each[k][m] for k in CLASSES}
    return out


def _matrix(y: Column, label: Column) -> Column:
    return F.to_json(F.array(*(F.array(*(F.count(F.when((y == a) & (label == p), 1)) for p in CLASSES)) for a in CLASSES)))


def evaluate_model_outputs(df: DataFrame, task: str, *, y: str = "y_target", pred: str = "y_pred", returns: str = "ret_fwd",
                           rule: str = "sign", by: Sequence[str] = ()) -> DataFrame:
    """Prediction and trading metrics of a model, as `base_*` and `trading_*` columns.

    One pass gives all of them but the AUC, which needs the scores in order. Three classes have means over
    the classes, a 3 x 3 matrix and no AUC; a volatility is scored like a value.
    """
    actual, predicted = F.col(returns), F.col(pred)
    if task in ("classification", "sign"):
        measures = _both_readings(F.col(y), predicted)
    elif task == "sign_3class":
        label = predicted.cast("int")
        measures = [c.alias(f"base_{n}") for n, c in _per_class(F.col(y), label).items()]
        measures.append(_matrix(F.col(y), label).alias("base_confusion_matrix"))
    elif task in ("regression", "price", "volatility"):
        found = _regression(F.col(y), predicted)
        measures = [found[m].alias(f"base_{m}") for m in ("mae", "mse", "rmse", "mape")]
    else:
        raise ValueError(f"unknown task {task!r}; use classification, sign_3class, volatility or regression")
    traded = F.when(actual.isNotNull() & predicted.isNotNull(), side_of(task, predicted, rule) * actual)
    trades = ("total_trades", "win_rate", "roi", "sharpe", "avg_return")
    sums = [c.alias(f"trading_{n}") for n, c in zip(trades, summarise_returns(traded))]
    wide = df.groupBy(*by).agg(*measures, *sums)
    if task not in ("classification", "sign"):
        return wide
    matrix = F.to_json(F.array(F.array("tn", "fp"), F.array("fn", "tp"))).alias("base_confusion_matrix")
    chosen = wide.select(*by, "is_probability", *_chosen_reading(), *(f"trading_{n}" for n in trades))
    joined = join_on(chosen, roc_auc(df, y, pred, by), by)
    return joined.select(*by, *(F.col(m).alias(f"base_{m}") for m in ("accuracy", "precision", "recall", "f1")),
                         F.when(F.col("is_probability"), F.col("auc")).alias("base_auc"), matrix,
                         *(f"trading_{n}" for n in trades))
