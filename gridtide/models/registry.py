"""Running many models over the same data and comparing them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.models.arx import Arx, arx_forecast
from gridtide.models.contract import Fitted, Model, check_contract, is_sign, predictions, prepared
from gridtide.models.kernel import rbf_regression
from gridtide.models.recurrent import reservoir_model
from gridtide.models.trees import gradient_boosting, random_forest
from gridtide.functions.scalars import return_to_probability
from gridtide.operators.scoring import evaluate_model_outputs, side_of
from gridtide.operators.targets import target_of
from gridtide.operators.trading import algo_return_summary
from gridtide.plans.dataset import Dataset, make_dataset
from gridtide.session import cut


@dataclass(frozen=True)
class Entry:
    """A named model: its function, its task, its parameters and the dataset it wants."""

    run: Model
    task: str = "sign"
    description: str = ""
    params: Mapping[str, Any] = field(default_factory=dict)
    dataset: Mapping[str, Any] = field(default_factory=dict)


def arx_model(data: Dataset, params: Mapping[str, Any]) -> Fitted:
    """The ARX forecast of the next return, as a value, a probability of going up, or one of three classes.

    The modelled series is the move into each row, shifted so that it lines up with the target.
    """
    exog = tuple(c for c in params.get("exog", ("gas_price", "temperature", "pjm_load")) if c in data.rows.columns)
    model = Arx(params.get("p", 2), params.get("P", 1), params.get("s", 7), params.get("d", 0), exog, "ret_fwd")
    raw = arx_forecast(data.rows, model, order=data.order)
    y_pred = return_to_probability(F.col("y_pred")) if is_sign(data.task) else F.col("y_pred")
    if data.task == "sign_3class":
        y_pred = target_of(data.task, F.col("y_pred"), params.get("flat_threshold", 0.001)).cast("double")
    elif data.task == "volatility":
        y_pred = F.abs("y_pred")
    return Fitted(predictions(raw, y_pred, data.order), dict(params))


def default_registry() -> dict[str, Entry]:
    """Ten models with their own default settings."""
    unscaled = {"scaler": None}
    return {
        "RF_sign": Entry(random_forest, "sign", "random forest on the direction"),
        "RF_price": Entry(random_forest, "price", "random forest on the return"),
        "GBT_sign": Entry(gradient_boosting, "sign", "boosted trees on the direction"),
        "GBT_price": Entry(gradient_boosting, "price", "boosted trees on the return"),
        "RBF_sign": Entry(rbf_regression, "sign", "kernel regression on the direction"),
        "RBF_price": Entry(rbf_regression, "price", "kernel regression on the return"),
        "ARX_sign": Entry(arx_model, "sign", "autoregression as a direction", dataset=unscaled),
        "ARX_price": Entry(arx_model, "price", "autoregression on the return", dataset=unscaled),
        "SEQ_sign": Entry(reservoir_model, "sign", "recurrent reservoir on sequences", {"seq_len": 14}, {"seq_len": 14}),
        "SEQ_price": Entry(reservoir_model, "price", "recurrent reservoir on sequences", {"seq_len": 14}, {"seq_len": 14}),
    }


def result_row(name: str, entry: Entry, fitted: Fitted, split: str = "test") -> DataFrame:
    """One flat row of prediction and trading metrics."""
    rows = cut(check_contract(fitted.predictions).filter(F.col("split") == split))
    table = evaluate_model_outputs(rows, entry.task)
    sides = side_of(entry.task, F.col("y_pred"))
    returns = algo_return_summary(rows.withColumn("_r", sides * F.col("ret_fwd")), "_r")
    returns = returns.select(*(F.col(c).alias(f"trading_{c}") for c in returns.columns))
    params = F.to_json(F.create_map(*(F.lit(str(x)) for kv in fitted.params.items() for x in kv))) if fitted.params else F.lit("{}")
    named = {"model_name": F.lit(name), "task_type": F.lit(entry.task), "description": F.lit(entry.description),
             "best_config": params, "error": F.lit(None).cast("string")}
    wide = table.crossJoin(F.broadcast(returns))  # one row each
    return wide.select(*(c.alias(n) for n, c in named.items()), *wide.columns)


def failure_row(spark, name: str, entry: Entry, error: Exception) -> DataFrame:
    text = f"{type(error).__name__}: {error}"
    return spark.createDataFrame([(name, entry.task, entry.description, text)],
                                 "model_name string, task_type string, description string, error string")


def union_results(tables: Sequence[DataFrame]) -> DataFrame:
    """Result rows of different models; metrics a model lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def run_models(raw: DataFrame, registry: Mapping[str, Entry] | None = None, *,
               make: Callable[..., Dataset] = make_dataset) -> DataFrame:
    """Fit and score every model; models with the same dataset options share one written dataset.

    A model that fails gives a row with its error instead of stopping the others.
    """
    registry = registry or default_registry()
    spark, tables, made = raw.sparkSession, [], {}
    for name, entry in registry.items():
        try:
            options = (entry.task, tuple(sorted(entry.dataset.items())))
            if options not in made:
                made[options] = prepared(make(raw, entry.task, **entry.dataset))
            # The row is kept as one small table, so that an error shows here and not in a later action.
            tables.append(cut(result_row(name, entry, entry.run(made[options], entry.params))))
        except Exception as error:
            tables.append(failure_row(spark, name, entry, error))
    return union_results(tables)


HIGHER = ("base_accuracy", "base_auc", "base_f1", "trading_roi", "trading_sharpe", "trading_win_rate")
LOWER = ("base_mae", "base_rmse")


def best_by_metric(results: DataFrame, higher: Sequence[str] = HIGHER, lower: Sequence[str] = LOWER, *,
                   name: str = "model_name") -> DataFrame:
    """The best model for each metric; of equal ones the first name."""
    present = [(m, 1) for m in higher if m in results.columns] + [(m, -1) for m in lower if m in results.columns]
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(s).alias("sign"))
                      for m, s in present))
    long = results.select(name, F.explode(cells).alias("_c")).select(name, "_c.*").filter(F.col("value").isNotNull())
    place = F.struct((-F.col("value") * F.col("sign")).alias("at"), F.col(name))
    return long.groupBy("metric").agg(F.min_by(name, place).alias("best_model"), F.min_by("value", place).alias("value"))


def seq_len_sweep(raw: DataFrame, lengths: Sequence[int] = (14, 30, 60), task: str = "price", params: Mapping[str, Any] | None = None,
                  **options) -> DataFrame:
    """The sequence model at several sequence lengths, one result row each."""
    tables = []
    for n in lengths:
        entry = Entry(reservoir_model, task, f"seq_len={n}", {**(params or {}), "seq_len": n})
        data = prepared(make_dataset(raw, task, seq_len=n, **options))
        tables.append(cut(result_row(f"seq_{n}", entry, entry.run(data, entry.params)).withColumn("seq_len", F.lit(n))))
    return union_results(tables)


def horizon_sweep(raw: DataFrame, horizons: Sequence[int] = (1, 5), task: str = "price", run: Model = gradient_boosting,
                  params: Mapping[str, Any] | None = None, **options) -> DataFrame:
    """A model at several forecast horizons, one result row each."""
    tables = []
    for h in horizons:
        entry = Entry(run, task, f"t+{h}", params or {})
        data = prepared(make_dataset(raw, task, horizon=h, **options))
        tables.append(cut(result_row(f"t+{h}", entry, entry.run(data, entry.params)).withColumn("horizon", F.lit(h))))
    return union_results(tables)


