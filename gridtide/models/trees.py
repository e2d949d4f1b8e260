"""Forests, boosted trees and perceptrons of MLlib behind the model contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.models.contract import (Fitted, assembled, better, class_column, held_out_score, is_class, is_sign, pipeline_model,
                                      positive_probability, predictions)
from gridtide.operators.sequences import flatten_sequence
from gridtide.plans.dataset import Dataset

SEED = 42


def weighted(rows: DataFrame, task: str, balanced: bool) -> tuple[DataFrame, dict[str, str]]:
    """With `balanced`, rows with a weight that gives every class of the training rows the same total, and the fit's option."""
    if not balanced or not is_class(task):
        return rows, {}
    train = F.col("split") == "train"
    counts = rows.filter(train).groupBy(F.col("y_target").alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))  # one row
    table = counts.crossJoin(F.broadcast(totals)).select("_class", (F.col("_all") / F.col("_classes") / F.col("_n")).alias("weight"))
    out = rows.join(F.broadcast(table), F.col("y_target") == F.col("_class"), "left").drop("_class")  # a row per class
    return out.fillna({"weight": 1.0}), {"weightCol": "weight"}


def random_forest(data: Dataset, params: Mapping[str, Any]) -> Fitted:
    """A forest whose number of trees is the first best one on the validation rows; the forests grow side by side."""
    assembler, rows = assembled(data)
    rows, extra = weighted(assembler.transform(rows), data.task, params.get("balanced", False))
    train = rows.filter(F.col("split") == "train")
    kind = RandomForestClassifier if is_class(data.task) else RandomForestRegressor
    options = params.get("n_estimators_options", (100, 200, 500))

    def grown(trees: int) -> tuple:
        estimator = kind(labelCol="y_target", numTrees=trees, maxDepth=params.get("max_depth", 8), seed=SEED,
                         minInstancesPerNode=params.get("min_samples_leaf", 1),
                         featureSubsetStrategy=params.get("max_features", "auto"), **extra)
        model = estimator.fit(train)
        y_pred = class_column(data.task) if is_class(data.task) else F.col("prediction")
        found = predictions(model.transform(rows.filter(F.col("split") != "train")), y_pred, data.order)
        return held_out_score(found, data.task), trees, model, found

    with ThreadPoolExecutor(len(options)) as pool:
        forests = list(pool.map(grown, options))
    best = forests[0]
    for forest in forests[1:]:
        if better(forest[0], best[0], data.task):
            best = forest
    score, trees, model, found = best
    return Fitted(found, {"n_estimators": trees, "val_score": score}, pipeline_model(assembler, model), data.features)


def best_prefix(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the least error before `patience` rounds without any gain, and whether that wait was over."""
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            return best + 1, True
    return best + 1, False


def boosted(estimator: GBTClassifier | GBTRegressor, train: DataFrame, val: DataFrame, most: int, patience: int) -> GBTClassificationModel | GBTRegressionModel:
    """The best prefix on `val` of a fit of `most` rounds.

    The first rounds of a fit don't depend on how many follow, so it is fitted with doubled numbers of rounds
    until the wait is over. Without validation rows all rounds stay.
    """
    if val.isEmpty():
        return estimator.copy({estimator.maxIter: most}).fit(train)
    rounds = min(most, 2 * patience)
    while True:
        model = estimator.copy({estimator.maxIter: rounds}).fit(train)
        loss = () if isinstance(model, GBTClassificationModel) else ("squared",)
        best, over = best_prefix(model.evaluateEachIteration(val, *loss), patience)
        if over or rounds >= most:
            break
        rounds = min(most, 2 * rounds)
    jvm, trees = train.sparkSession.sparkContext._jvm, model._java_obj.trees()
    kept = train.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, best)
    weights = train.sparkSession.sparkContext._gateway.new_array(jvm.double, best)
    for at in range(best):
        kept[at], weights[at] = trees[at], model.treeWeights[at]
    kind = getattr(jvm.org.apache.spark.ml, "classification" if loss == () else "regression")
    short = getattr(kind, type(model).__name__)(model.uid, kept, weights, model.numFeatures, *(() if loss else (2,)))
    return type(model)(model._java_obj.copyValues(short, model._java_obj.extractParamMap()))


def gradient_boosting(data: Dataset, params: Mapping[str, Any]) -> Fitted:
    """Boosted trees up to the best round on the validation rows; three classes are one fit against the rest each, side by side."""
    assembler, rows = assembled(data)
    rows, extra = weighted(assembler.transform(rows), data.task, params.get("balanced", False))
    most, patience = params.get("n_estimators", 1000), params.get("early_stopping_rounds", 50)
    settings = dict(stepSize=params.get("learning_rate", 0.05),
                    maxDepth=params.get("max_depth", 5), subsamplingRate=params.get("subsample", 0.8),
                    featureSubsetStrategy=str(params.get("colsample", 0.8)), minInstancesPerNode=params.get("min_child_samples", 20),
                    seed=SEED, **extra)
    train, val, unseen = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "val"), rows.filter(F.col("split") != "train")
    if data.task == "sign_3class":
        def against_rest(k: int) -> GBTClassificationModel:
            own = (F.col("y_target") == k).cast("double")
            estimator = GBTClassifier(labelCol="_own", predictionCol=f"_label{k}", **settings)
            estimator = estimator.setRawPredictionCol(f"_raw{k}").setProbabilityCol(f"_p{k}")
            return boosted(estimator, train.withColumn("_own", own), val.withColumn("_own", own), most, patience)

        with ThreadPoolExecutor(3) as pool:
            models = list(pool.map(against_rest, range(3)))
        scored = unseen
        for model in models:
            scored = model.transform(scored)
        votes = F.array(*(F.struct(positive_probability(f"_p{k}").alias("p"), F.lit(-k).alias("first")) for k in range(3)))
        found = predictions(scored.withColumn("_vote", F.array_max(votes)), (-F.col("_vote.first")).cast("double"), data.order)
        return Fitted(found, {**params, "trees": sum(m.getNumTrees for m in models)}, pipeline_model(assembler, *models), data.features)
    model = boosted((GBTClassifier if is_sign(data.task) else GBTRegressor)(labelCol="y_target", **settings), train, val, most, patience)
    y_pred = class_column(data.task) if is_sign(data.task) else F.col("prediction")
    found = predictions(model.transform(unseen), y_pred, data.order)
    return Fitted(found, {**params, "trees": model.getNumTrees}, pipeline_model(assembler, model), data.features)


def sequence_model(data: Dataset, params: Mapping[str, Any]) -> Fitted:
    """A learner on whole sequences: a perceptron for classes, boosted trees for the value."""
    if "seq" not in data.rows.columns:
        raise ValueError("the sequence model needs a dataset with sequences; give seq_len")
    rows = flatten_sequence(data.rows, name="_flat").withColumns(
        {"features": array_to_vector("_flat"), "y_target": F.col("y_target").cast("double")}).drop("_flat")
    length = params["seq_len"] * len(data.features)
    train, rest = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") != "train")
    if is_class(data.task):
        model = MultilayerPerceptronClassifier(
            labelCol="y_target", layers=[length, *params.get("hidden", (32,)), 2 if is_sign(data.task) else 3], seed=SEED,
            maxIter=params.get("max_epochs", 40), blockSize=params.get("batch_size", 128)).fit(train)
        found = predictions(model.transform(rest), class_column(data.task), data.order)
    else:
        model = GBTRegressor(labelCol="y_target", maxIter=params.get("max_epochs", 20), maxDepth=params.get("max_depth", 3),
                             stepSize=params.get("learning_rate", 0.1), featureSubsetStrategy="sqrt", seed=SEED).fit(train)
        found = predictions(model.transform(rest), F.col("prediction"), data.order)
    return Fitted(found, dict(params), pipeline_model(model), data.features)


def feature_importances(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """Feature and importance, one row each; a fitted model holds one number per feature."""
    values = fitted.model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(fitted.names, values)], "feature string, importance double")


def feature_importance_topn(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
