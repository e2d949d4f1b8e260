"""A learner with a state over the steps of a sequence: a fixed recurrent reservoir and a ridge read-out.

Each sequence drives a network whose weights are drawn once and never trained; a unit keeps part of its
state from step to step. What the last state says about the target is a linear fit, and that is solved
from cross products which every task sums for its own rows. Nothing is passed over more than three times:
for the scale of the inputs, for the sums, and for the forecasts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.models.contract import Fitted, is_class, is_sign, predictions
from gridtide.plans.dataset import Dataset

SEED = 42
UNITS = 64
LEAK = 0.5
RADIUS = 0.9
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
BATCH = 2048


class Reservoir(NamedTuple):
    """Input weights with a row for a constant, recurrent weights with the given spectral radius, and what a unit takes on per step."""

    enter: np.ndarray
    turn: np.ndarray
    leak: float

    @staticmethod
    def drawn(features: int, units: int = UNITS, leak: float = LEAK, radius: float = RADIUS, seed: int = SEED) -> Reservoir:
        rng = np.random.default_rng(seed)
        enter = rng.uniform(-1, 1, (features + 1, units)) / np.sqrt(features + 1)
        turn = rng.standard_normal((units, units))
        return Reservoir(enter, turn * (radius / np.abs(np.linalg.eigvals(turn)).max()), leak)

    def states(self, x: np.ndarray) -> np.ndarray:
        """The last state of each of (sequences, steps, features)."""
        h = np.zeros((len(x), self.turn.shape[0]))
        for step in range(x.shape[1]):
            h = (1 - self.leak) * h + self.leak * np.tanh(x[:, step] @ self.enter[:-1] + self.enter[-1] + h @ self.turn)
        return h

    def design(self, x: np.ndarray) -> np.ndarray:
        """A constant, the last state, its squares, and the last step itself."""
        h = self.states(x)
        return np.concatenate([np.ones((len(x), 1)), h, h * h, x[:, -1]], axis=1)


def _steps(column: pa.Array, features: int) -> Iterator[np.ndarray]:
    """(sequences, steps, features) of a column of equally long sequences, a bounded number at a time; missing entries are NaN."""
    for begin in range(0, len(column), BATCH):
        part = column.slice(begin, BATCH)
        flat = pc.list_flatten(pc.list_flatten(part)).cast(pa.float64())
        yield pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(len(part), -1, features)


def input_scale(rows: DataFrame, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all steps of the sequences, from sums and sums of squares."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _steps(batch.column(0), features):
                flat = x.reshape(-1, features)
                known = np.isfinite(flat)
                flat = np.where(known, flat, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(range(features), pa.int32()), pa.array(known.sum(axis=0).astype(float)), pa.array(flat.sum(axis=0)),
                                                  pa.array((flat * flat).sum(axis=0))], names=["at", "n", "s", "q"])

    summed = rows.select("seq").mapInArrow(partial, "at int, n double, s double, q double").groupBy("at").agg(*(F.sum(c).alias(c) for c in "nsq"))
    mean, spread = np.zeros(features), np.ones(features)
    for at, n, s, q in summed.collect():
        mean[at] = s / max(n, 1.0)
        deviation = np.sqrt(max(q / max(n, 1.0) - mean[at] ** 2, 0.0))
        spread[at] = deviation if deviation > 1e-12 * max(1.0, abs(mean[at])) else 1.0
    return mean, spread


def _targets(y: np.ndarray, classes: int) -> np.ndarray:
    return y[:, None] if classes == 1 else (y[:, None] == np.arange(classes)).astype(float)


def readout_sums(rows: DataFrame, reservoir: Reservoir, mean: np.ndarray, spread: np.ndarray, classes: int) -> dict[str, tuple[np.ndarray, np.ndarray, float, float]]:
    """Per split: cross products of the design, with the targets, the targets' squares, and the number of rows. The driver gets sums only."""
    features, wide = len(mean), 1 + 2 * reservoir.turn.shape[0] + len(mean)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            split = np.array(batch.column(0).to_pylist(), dtype=object)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for i, x in enumerate(_steps(batch.column(2), features)):
                z = reservoir.design(np.nan_to_num((x - mean) / spread))
                own = slice(i * BATCH, i * BATCH + len(z))
                t = _targets(y[own], classes)
                for name in set(split[own]):
                    at = split[own] == name
                    sums = np.concatenate([(z[at].T @ np.concatenate([z[at], t[at]], axis=1)).ravel(), [(t[at] ** 2).sum(), at.sum()]])
                    held[name] = held.get(name, 0.0) + sums
        for name, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums)), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["split", "at", "v"])

    found = rows.select("split", F.col("y_target").cast("double").alias("y"), "seq").mapInArrow(partial, "split string, at int, v double")
    table = found.groupBy("split", "at").agg(F.sum("v").alias("v")).toPandas().sort_values(["split", "at"])
    out = {}
    for name, own in table.groupby("split"):
        values = own["v"].to_numpy()
        both = values[:-2].reshape(wide, wide + classes)
        out[name] = (both[:, :wide], both[:, wide:], float(values[-2]), float(values[-1]))
    return out


def ridge(train: tuple, val: tuple | None) -> tuple[np.ndarray, float]:
    """The read-out whose penalty leaves the least squared error on the validation rows, by their sums; without any, the middle penalty."""
    a, b, _, n = train
    scale = np.sqrt(np.maximum(np.diag(a) / n, 1e-12))
    unit, right = a / np.outer(scale, scale) / n, b / scale[:, None] / n
    best = None
    for penalty in PENALTIES if val else PENALTIES[len(PENALTIES) // 2: len(PENALTIES) // 2 + 1]:
        ridged = unit + penalty * np.eye(len(unit))
        ridged[0, 0] = unit[0, 0]
        w = np.linalg.solve(ridged, right) / scale[:, None]
        error = val[2] - 2 * float((w * val[1]).sum()) + float((w * (val[0] @ w)).sum()) if val else 0.0
        if best is None or error < best[0]:
            best = (error, penalty, w)
    return best[2], best[1]


def reservoir_model(data: Dataset, params: Mapping[str, Any]) -> Fitted:
    """The last state of a reservoir over each sequence, read out for the value, the probability of the upper class, or the class.

    Missing inputs count as their mean. Equal data gives equal forecasts: the weights depend on the seed and the number of features only.
    """
    if "seq" not in data.rows.columns:
        raise ValueError("the sequence model needs a dataset with sequences; give seq_len")
    features, classes = len(data.features), 3 if is_class(data.task) and not is_sign(data.task) else 1
    reservoir = Reservoir.drawn(features, params.get("units", UNITS), params.get("leak", LEAK), params.get("radius", RADIUS), params.get("seed", SEED))
    rows = data.rows.withColumn("y_target", F.col("y_target").cast("double"))
    mean, spread = input_scale(rows.filter(F.col("split") == "train"), features)
    sums = readout_sums(rows.filter(F.col("split").isin("train", "val") & F.col("y_target").isNotNull()), reservoir, mean, spread, classes)
    if "train" not in sums:
        raise ValueError("no training sequences")
    sign = is_sign(data.task)
    weights, penalty = ridge(sums["train"], sums.get("val"))

    @F.arrow_udf("double")
    def forecast(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [reservoir.design(np.nan_to_num((x - mean) / spread)) @ weights for x in _steps(column, features)]
            read = np.concatenate(parts) if parts else np.zeros((0, classes))
            yield pa.array(read.argmax(axis=1).astype(float) if classes > 1 else np.clip(read[:, 0], 0, 1) if sign else read[:, 0])

    found = predictions(rows.filter(F.col("split") != "train").withColumn("_read", forecast("seq")), F.col("_read"), data.order)
    return Fitted(found, {**params, "penalty": penalty}, None, data.features)
