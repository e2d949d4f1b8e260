"""Kernel regression and classification with margins, through random Fourier features (Rahimi and Recht, 2007).

The losses are those of support vector machines: the absolute error beyond a margin of `epsilon` for values, the
hinge for signs. Each is a sum of absolute values, and an absolute value |u| lies below
u^2 / 2|v| + |v| / 2 and touches it at u = v. So a round weighs each row by its residual, sums weighted cross products and
solves them; the loss falls from round to round. A round is one pass over the rows and one small matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.scalars import score_to_probability
from gridtide.models.contract import Fitted, is_sign, pipeline_model, predictions
from gridtide.operators.scaling import standard_scale
from gridtide.operators.statistics import topk_features
from gridtide.plans.dataset import Dataset
from gridtide.session import cut

SEED = 42
LEAST_RESIDUAL = 1e-4


def fourier_features(columns: Sequence[str], count: int, gamma: float, seed: int = SEED) -> Column:
    """An array whose inner products approximate exp(-gamma * |a - b|^2)."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=np.sqrt(2.0 * gamma), size=(len(columns), count))
    shift = rng.uniform(0, 2 * np.pi, size=count)

    @F.pandas_udf("array<double>")
    def lift(batch: pd.Series) -> pd.Series:
        x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, len(columns)))
        return pd.Series(list(np.sqrt(2.0 / count) * np.cos(x @ weights + shift)))

    return lift(F.array(*(F.col(c).cast("double") for c in columns)))


def selected_features(data: Dataset, k: int) -> list[str]:
    """The names of the k best features by correlation on the training rows; k names, not rows."""
    if len(data.features) <= k:
        return list(data.features)
    train = data.rows.filter(F.col("split") == "train")
    return [r["feature"] for r in topk_features(train, data.features, k).collect()]


def pull(hinge: bool, y: np.ndarray, f: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, weighted target and loss of each row at the present forecasts: the quadratic a f^2 / 2 - t f lies above the loss, up to a constant."""
    if hinge:
        near = 1 / np.maximum(np.abs(1 - y * f), LEAST_RESIDUAL)
        return near / 2, y * (1 + near) / 2, np.maximum(1 - y * f, 0.0)
    above, below = (1 / np.maximum(np.abs(y - e - f), LEAST_RESIDUAL) for e in (epsilon, -epsilon))
    return (above + below) / 2, ((y - epsilon) * above + (y + epsilon) * below) / 2, np.maximum(np.abs(y - f) - epsilon, 0.0)


def pulled_sums(rows: DataFrame, coef: np.ndarray, hinge: bool, epsilon: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weighted cross products of the lifted features and a constant, with the targets, the loss and the number of rows; sums only."""
    wide = len(coef)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(wide * (wide + 1) + 2)
        for batch in batches:
            x = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(-1, wide - 1)
            z, y = np.concatenate([x, np.ones((len(x), 1))], axis=1), batch.column(1).to_numpy(zero_copy_only=False)
            a, t, loss = pull(hinge, y, z @ coef, epsilon)
            held += np.concatenate([(z.T @ np.concatenate([z * a[:, None], t[:, None]], axis=1)).ravel(), [loss.sum(), len(y)]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(held)], names=["at", "v"])

    summed = rows.select("_lifted", "_label").mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    table = summed.toPandas().sort_values("at")["v"].to_numpy()  # one number per pair of features
    if not len(table):
        return np.zeros((wide, wide)), np.zeros(wide), 0.0, 0.0
    both = table[:-2].reshape(wide, wide + 1)
    return both[:, :wide], both[:, wide], float(table[-2]), float(table[-1])


def margin_fit(rows: DataFrame, wide: int, penalty: float, *, hinge: bool = False, epsilon: float = 0.1, rounds: int = 60,
               tolerance: float = 1e-4) -> tuple[np.ndarray, int]:
    """Coefficients and last a constant with the least mean loss + penalty / 2 * |coefficients|^2, and the rounds that it took.

    `rows` have `_lifted` (array of `wide` numbers) and `_label`, a value or -1 and 1. It ends when a round takes less than `tolerance` off
    what is left.
    """
    coef, before = np.zeros(wide + 1), np.inf
    ridge = penalty * np.diag([1.0] * wide + [0.0])
    for done in range(rounds):
        a, t, loss, n = pulled_sums(rows, coef, hinge, epsilon)
        if not n:
            raise ValueError("no training rows")
        now = loss / n + penalty / 2 * float(coef[:-1] @ coef[:-1])
        if before - now < tolerance * now and done > 1:
            return coef, done
        before, coef = now, np.linalg.lstsq(a / n + ridge, t / n, rcond=1e-12)[0]
    return coef, rounds


def rbf_regression(data: Dataset, params: Mapping[str, Any]) -> Fitted:
    """The best features scaled again, lifted, and fitted with a margin: values with errors up to `epsilon` deviations free, signs by the hinge.

    Of three classes it is the one nearest to the value. `C` weighs the mean loss against the coefficients. The model of the result reads rows
    with `_lifted`.
    """
    names = selected_features(data, params.get("n_features", 50))
    rows = standard_scale(data.rows, names, per=False, order=data.order)
    gamma = params.get("gamma", "scale")
    gamma = 1.0 / len(names) if gamma in ("scale", "auto") else float(gamma)
    count, sign, train = params.get("components", 100), is_sign(data.task), F.col("split") == "train"
    rows = rows.withColumn("_lifted", fourier_features(names, count, gamma))
    # Two numbers scale the target: a margin is in units of its deviation. Signs are -1 and 1.
    mean, spread = (0.5, 0.5) if sign else rows.filter(train).agg(F.avg("y_target"), F.stddev_pop("y_target")).first()
    spread = spread or 1.0
    rows = rows.withColumn("_label", (F.col("y_target") - mean) / spread)
    rows = cut(rows.select(*data.order.columns(), "idx", "split", "y_target", "ret_fwd", "_lifted", "_label"))
    coef, rounds = margin_fit(rows.filter(train & F.col("_label").isNotNull()), count, 1.0 / params.get("C", 1000), hinge=sign,
                              epsilon=params.get("epsilon", 0.1), rounds=params.get("max_iter", 60))
    weights = ", ".join(f"{float(w)!r}D" for w in coef[:-1])
    model = SQLTransformer(statement=f"SELECT *, aggregate(zip_with(_lifted, array({weights}), (x, w) -> x * w), {float(coef[-1])!r}D, (s, x) -> s + x) AS prediction FROM __THIS__")
    raw = F.col("prediction") * spread + mean
    scored = model.transform(rows.filter(F.col("split") != "train"))
    y_pred = score_to_probability(raw) if sign else raw
    if data.task == "sign_3class":  # the nearest class
        y_pred = F.greatest(F.least(F.rint(raw), F.lit(2.0)), F.lit(0.0))
    found = predictions(scored, y_pred, data.order)
    return Fitted(found, {**params, "gamma": gamma, "features": len(names), "rounds": rounds}, pipeline_model(model), names)


def lifted(df: DataFrame, columns: Sequence[str], count: int = 100, gamma: float | None = None) -> DataFrame:
    return df.withColumn("lifted", fourier_features(columns, count, gamma or 1.0 / len(columns)))
