"""Seeded search over hyperparameters with chronological folds: random draws first, then draws by a density model of the scores.

The model is the tree-structured density estimator of Bergstra et al. (2011): one density of the values of
good draws and one of the others for each hyperparameter; the next draw is the candidate with the best ratio.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.models.contract import Model, better, held_out_score, is_class
from gridtide.operators.targets import time_series_folds
from gridtide.plans.dataset import Dataset
from gridtide.session import cut


def _drawn(choice: Any, rng: random.Random) -> Any:
    if _is_log(choice):
        return math.exp(rng.uniform(math.log(choice[1]), math.log(choice[2])))
    if _is_range(choice):
        return rng.randint(*choice) if _is_whole(choice) else rng.uniform(*choice)
    return rng.choice(list(choice))


def _is_log(choice: Any) -> bool:
    return isinstance(choice, tuple) and len(choice) == 3 and choice[0] == "log"


def _is_range(choice: Any) -> bool:
    return isinstance(choice, tuple) and len(choice) == 2


def _is_whole(choice: tuple) -> bool:
    return isinstance(choice[0], int) and isinstance(choice[1], int)


def draw_params(space: Mapping[str, Any], n: int, seed: int = 42) -> list[dict[str, Any]]:
    """n draws: one of a list, a whole number between two ints, or a number between two floats.

    ("log", low, high) draws a number whose logarithm is uniform.
    """
    rng = random.Random(seed)
    return [{name: _drawn(choice, rng) for name, choice in space.items()} for _ in range(n)]


def _place(choice: Any, value: Any) -> float:
    """Where a value lies in its range, from 0 to 1."""
    if _is_log(choice):
        low, high = math.log(choice[1]), math.log(choice[2])
        return (math.log(value) - low) / (high - low) if high > low else 0.5
    low, high = choice
    if _is_whole(choice):
        return (value - low + 0.5) / (high - low + 1)
    return (value - low) / (high - low) if high > low else 0.5


def _value(choice: Any, place: float) -> Any:
    if _is_log(choice):
        low, high = math.log(choice[1]), math.log(choice[2])
        return math.exp(low + place * (high - low))
    low, high = choice
    return min(low + int(place * (high - low + 1)), high) if _is_whole(choice) else low + place * (high - low)


class Density:
    """How values of one hyperparameter are spread: normal kernels in its range and a flat part, or counts of a list's values."""

    def __init__(self, choice: Any, values: Sequence[Any]):
        self.choice, self.numeric = choice, _is_log(choice) or _is_range(choice)
        if self.numeric:
            self.places = [_place(choice, v) for v in values]
            self.width = max(0.3 * (len(values) + 1) ** -0.5, 0.02)
        else:
            self.options = list(choice)
            self.counts = [1 / len(self.options) + sum(v == o for v in values) for o in self.options]

    def draw(self, rng: random.Random) -> Any:
        if not self.numeric:
            return rng.choices(self.options, self.counts)[0]
        at = rng.randrange(len(self.places) + 1)
        if at == len(self.places):
            return _value(self.choice, rng.random())
        while True:
            place = rng.gauss(self.places[at], self.width)
            if 0 <= place <= 1:
                return _value(self.choice, place)

    def log(self, value: Any) -> float:
        if not self.numeric:
            return math.log(self.counts[self.options.index(value)] / sum(self.counts))
        x, root = _place(self.choice, value), self.width * math.sqrt(2)
        mass = 1.0
        for p in self.places:
            inside = 0.5 * (math.erf((1 - p) / root) + math.erf(p / root))
            mass += math.exp(-((x - p) / root) ** 2) / (self.width * math.sqrt(2 * math.pi) * inside)
        return math.log(mass / (len(self.places) + 1))


def proposed(space: Mapping[str, Any], told: Sequence[tuple[dict, float]], count: int, rng: random.Random, *, higher: bool,
             good: float = 0.25, candidates: int = 24) -> list[dict[str, Any]]:
    """The next draws after those `told` with their scores. A draw that is not scored yet counts as one of the others."""
    ranked = [p for p, _ in sorted(told, key=lambda x: -x[1] if higher else x[1])]
    cut_at = max(1, math.ceil(good * len(ranked)))
    best, others, out = ranked[:cut_at], ranked[cut_at:], []
    near = {name: Density(choice, [p[name] for p in best]) for name, choice in space.items()}
    for _ in range(count):
        far = {name: Density(choice, [p[name] for p in others]) for name, choice in space.items()}
        tried = [{name: d.draw(rng) for name, d in near.items()} for _ in range(candidates)]
        out.append(max(tried, key=lambda p: sum(near[name].log(p[name]) - far[name].log(p[name]) for name in space)))
        others = [*others, out[-1]]
    return out


def searched(space: Mapping[str, Any], draws: int, scored: Callable[[list[dict]], list[float]], *, higher: bool, seed: int = 42,
             start: int = 15, batch: int = 5) -> list[tuple[dict, float]]:
    """`draws` draws with their scores: `start` random ones, then batches proposed by those before. The same seed and scores give the same draws."""
    first = draw_params(space, min(start, draws), seed)
    told, rng = list(zip(first, scored(first))), random.Random(seed + 1)
    while len(told) < draws:
        more = proposed(space, told, min(batch, draws - len(told)), rng, higher=higher)
        told += zip(more, scored(more))
    return told


def fold_dataset(rows: DataFrame, data: Dataset, fold: int) -> Dataset:
    """Train on the folds before, validate on this one."""
    part = F.when(F.col("fold") < fold, "train").when(F.col("fold") == fold, "val")
    return replace(data, rows=rows.withColumn("split", part).filter(F.col("split").isNotNull()))


def hyperparameter_search(data: Dataset, model: Model, space: Mapping[str, Sequence], *, draws: int = 50, folds: int = 5,
                          seed: int = 42, threads: int = 4, start: int = 15, batch: int = 5) -> DataFrame:
    """One row per draw: its parameters as JSON, its mean score over the folds, and whether it is best.

    After `start` random draws, batches follow the densities of good and other draws. The fits of a batch are
    Spark jobs started from a few threads; only scores come back.
    """
    train = data.rows.filter(F.col("split") == "train").drop("idx")
    rows = cut(time_series_folds(train, folds, order=data.order))

    def score(job: tuple[dict, int]) -> float:
        params, fold = job
        return held_out_score(model(fold_dataset(rows, data, fold), params).predictions, data.task)

    def scored(candidates: list[dict]) -> list[float]:
        found = list(pool.map(score, [(p, fold) for p in candidates for fold in range(1, folds + 1)]))
        return [sum(found[i * folds: (i + 1) * folds]) / folds for i in range(len(candidates))]

    with ThreadPoolExecutor(threads) as pool:
        told = searched(space, draws, scored, higher=is_class(data.task), seed=seed, start=start, batch=batch)
    best = None
    for at, (_, mean) in enumerate(told):
        if best is None or better(mean, told[best][1], data.task):
            best = at
    schema = "draw int, params map<string,string>, score double, is_best boolean"
    named = [(at, {k: str(v) for k, v in p.items()}, mean, at == best) for at, (p, mean) in enumerate(told)]
    out = data.rows.sparkSession.createDataFrame(named, schema).withColumn("params", F.to_json("params"))
    return out.withColumn("metric", F.lit("accuracy" if is_class(data.task) else "mae"))
