"""Results, experiments and models in shared storage."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPERIMENT = ("experiment_id string, data_split map<string,string>, models map<string,map<string,double>>, "
              "best_model string, notes string")
PARAMS = "model_name string, params map<string,string>"


class NotStored(LookupError):
    """Nothing is stored under this name."""


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write a results table; CSV gets a heading line."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def read_results(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


class ExperimentStore:
    """Experiments and best parameters; the latest row of a name counts.

    Each write is a snapshot of its own with rows laid out by name, and a line in the manifest once all of it is there: readers
    see whole writes only, writers never touch each other's files, and loading one name reads that name's folders.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.experiments = f"{path.rstrip('/')}/experiments"
        self.params = f"{path.rstrip('/')}/params"

    def _append(self, df: DataFrame, path: str, name: str) -> None:
        snapshot = uuid.uuid4().hex
        df.withColumn("_saved_at", F.current_timestamp()).write.partitionBy(name).json(f"{path}/data/snapshot={snapshot}")
        # A folder of its own: appends to one folder share their temporary files, and the first to end takes those of the others along.
        self.spark.createDataFrame([(True,)], "whole boolean").write.json(f"{path}/manifest/snapshot={snapshot}")

    def _rows(self, path: str, schema: str, name: str, wanted: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, _saved_at timestamp, snapshot string").json(f"{path}/data")
        rows = rows if wanted is None else rows.filter(F.col(name) == wanted)
        return rows.join(self.spark.read.schema("whole boolean, snapshot string").json(f"{path}/manifest").filter("whole"), "snapshot", "left_semi")

    def save_experiments(self, df: DataFrame) -> None:
        """Append rows with `experiment_id`, `data_split`, `models`, `best_model` and `notes`."""
        self._append(df, self.experiments, "experiment_id")

    def save_experiment(self, experiment_id: str, data_split: Mapping[str, str], models: Mapping[str, Mapping[str, float]],
                        best_model: str | None = None, notes: str | None = None) -> None:
        native = {m: {k: float(v) for k, v in d.items()} for m, d in models.items()}
        row = (experiment_id, dict(data_split), native, best_model, notes)
        self.save_experiments(self.spark.createDataFrame([row], EXPERIMENT))

    def load_experiments(self, experiment_id: str | None = None) -> DataFrame:
        """The latest row of every experiment, or of one."""
        rows = self._rows(self.experiments, EXPERIMENT, "experiment_id", experiment_id)
        latest = F.max_by(F.struct("data_split", "models", "best_model", "notes"), F.struct("_saved_at", "snapshot"))
        return rows.groupBy("experiment_id").agg(latest.alias("latest")).select("experiment_id", "latest.*")

    def load_experiment(self, experiment_id: str) -> DataFrame:
        found = self.load_experiments(experiment_id)
        if found.isEmpty():
            raise NotStored(f"no experiment {experiment_id!r}")
        return found

    def list_experiments(self) -> DataFrame:
        return self._rows(self.experiments, EXPERIMENT, "experiment_id").select("experiment_id").distinct().orderBy("experiment_id")

    def save_params(self, model_name: str, params: Mapping[str, Any]) -> None:
        row = (model_name, {k: json.dumps(v, default=float) for k, v in params.items()})
        self._append(self.spark.createDataFrame([row], PARAMS), self.params, "model_name")

    def load_params(self, model_name: str) -> dict[str, Any]:
        found = self._rows(self.params, PARAMS, "model_name", model_name).orderBy(F.desc("_saved_at"), F.desc("snapshot")).first()
        if found is None:
            raise NotStored(f"no parameters for {model_name!r}")
        return {k: json.loads(v) for k, v in found["params"].items()}


def save_model(spark: SparkSession, model: PipelineModel, path: str, metadata: Mapping[str, Any]) -> str:
    """Write a fitted pipeline and one row of metadata next to it."""
    base = path.rstrip("/")
    model.write().overwrite().save(f"{base}/model")
    spark.createDataFrame([(json.dumps(dict(metadata), default=str),)], "metadata string").write.mode("overwrite").json(f"{base}/metadata")
    return base


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, Any]]:
    base = path.rstrip("/")
    row = spark.read.schema("metadata string").json(f"{base}/metadata").first()
    if row is None:
        raise NotStored(f"no model at {path}")
    return PipelineModel.load(f"{base}/model"), json.loads(row["metadata"])
