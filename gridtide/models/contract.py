"""What a model is here: a function from a dataset to predictions.

A model takes (dataset, params) and returns a `Fitted`: the validation and test rows as series key,
time, `idx`, `split`, `y_target`, `ret_fwd`, `y_pred`. For the sign task `y_pred` is a probability, for three
classes it is the class.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.plans.dataset import Dataset
from gridtide.plans.timeline import DAILY, SeriesOrder
from gridtide.session import cut

CONTRACT = ("idx", "split", "y_target", "ret_fwd", "y_pred")
HELD_OUT = ("val", "test")


@dataclass(frozen=True)
class Fitted:
    predictions: DataFrame
    params: Mapping[str, Any]
    model: Transformer | None = None
    names: Sequence[str] = field(default=())


Model = Callable[[Dataset, Mapping[str, Any]], Fitted]


class ContractError(ValueError):
    """A model's predictions lack a column."""


def check_contract(predictions: DataFrame) -> DataFrame:
    missing = [c for c in CONTRACT if c not in predictions.columns]
    if missing:
        raise ContractError("predictions lack " + ", ".join(missing))
    return predictions


def is_sign(task: str) -> bool:
    """Two classes, predicted by the probability of the upper one."""
    return task in ("sign", "classification")


def is_class(task: str) -> bool:
    return is_sign(task) or task == "sign_3class"


def prepared(data: Dataset) -> Dataset:
    """The dataset written out once, for fits that pass over it many times."""
    return replace(data, rows=cut(data.rows))


def assembled(data: Dataset) -> tuple[VectorAssembler, DataFrame]:
    return VectorAssembler(inputCols=list(data.features), outputCol="features"), data.rows.withColumn(
        "y_target", F.col("y_target").cast("double"))


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def class_column(task: str) -> Column:
    """What a fitted classifier predicts for a task."""
    return positive_probability() if is_sign(task) else F.col("prediction")


def predictions(scored: DataFrame, y_pred: Column, order: SeriesOrder = DAILY) -> DataFrame:
    out = scored.filter(F.col("split").isin(*HELD_OUT)).withColumn("y_pred", y_pred)
    return check_contract(out.select(*order.columns(), *CONTRACT))


def held_out_score(predicted: DataFrame, task: str, split: str = "val") -> float:
    """Accuracy of the class or mean absolute error on a split; one number."""
    rows = predicted.filter(F.col("split") == split)
    if is_class(task):
        label = (F.col("y_pred") > 0.5).cast("int") if is_sign(task) else F.col("y_pred")
        value = F.avg((label == F.col("y_target")).cast("double"))
    else:
        value = F.avg(F.abs(F.col("y_target") - F.col("y_pred")))
    return rows.agg(value).first()[0]


def better(a: float, b: float | None, task: str) -> bool:
    """Whether score a beats b; the first of equal scores stays."""
    return b is None or (a > b if is_class(task) else a < b)


def pipeline_model(*stages: Transformer) -> PipelineModel:
    return PipelineModel(list(stages))
