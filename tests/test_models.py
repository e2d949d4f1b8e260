"""Models on a planted signal, the registry, the search and the store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.models import trees
from gridtide.models.contract import CONTRACT, ContractError, check_contract, held_out_score
from gridtide.models.kernel import lifted, margin_fit, rbf_regression
from gridtide.models.registry import Entry, arx_model, best_by_metric, run_models
from gridtide.models.search import draw_params, hyperparameter_search, searched
from gridtide.plans.dataset import Dataset
from gridtide.sources.results import load_model, save_model


@pytest.fixture(scope="module")
def planted(spark):
    """Two series whose next move follows a feature, with a second feature of noise."""
    rng = np.random.default_rng(1)
    data = []
    for key in "ab":
        for i in range(400):
            x, z = rng.normal(), rng.normal()
            r = 0.02 * x + 0.004 * rng.normal()
            split = "train" if i < 280 else "val" if i < 340 else "test"
            data.append((key, i, split, float(x), float(z), float(r), int(r > 0)))
    df = spark.createDataFrame(data, "series_id string, idx long, split string, signal double, noise double, ret_fwd double, up int")
    return df.withColumn("trade_date", F.date_from_unix_date(F.col("idx").cast("int"))).cache()


def dataset(planted, task):
    target = F.col("up") if task == "sign" else F.col("ret_fwd")
    return Dataset(planted.withColumn("y_target", target).drop("up"), ("signal", "noise"), task)


MODELS = {
    "forest": (trees.random_forest, {"n_estimators_options": (5, 10), "max_depth": 4, "max_features": "all"}),
    "boosted": (trees.gradient_boosting, {"n_estimators": 10, "max_depth": 3, "colsample": "all", "learning_rate": 0.3}),
    "kernel": (rbf_regression, {"components": 60}),
}


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("task", ["sign", "price"])
def test_models_beat_their_baseline(planted, name, task):
    run, params = MODELS[name]
    data = dataset(planted, task)
    fitted = run(data, params)
    assert set(CONTRACT) <= set(fitted.predictions.columns)
    assert {r["split"] for r in fitted.predictions.select("split").distinct().collect()} == {"val", "test"}
    score = held_out_score(fitted.predictions, task, "test")
    if task == "sign":
        assert score > 0.8
        assert fitted.predictions.filter("y_pred < 0 OR y_pred > 1").count() == 0
    else:
        zero = held_out_score(fitted.predictions.withColumn("y_pred", F.lit(0.0)), task, "test")
        assert score < 0.6 * zero


def test_importances_find_the_signal(spark, planted):
    fitted = trees.random_forest(dataset(planted, "price"), {"n_estimators_options": (5,), "max_depth": 4, "max_features": "all"})
    top = trees.feature_importance_topn(trees.feature_importances(spark, fitted), 1).first()
    assert top["feature"] == "signal" and top["importance"] > 0.7


@pytest.mark.parametrize("task", ["sign", "price"])
def test_sequence_model_learns_from_the_last_step(planted, task):
    from gridtide.operators.sequences import sequences_same

    data = dataset(planted, task)
    data = Dataset(sequences_same(data.rows, data.features, 3), data.features, task)
    fitted = trees.sequence_model(data, {"seq_len": 3, "hidden": (8,), "max_epochs": 30})
    score = held_out_score(fitted.predictions, task, "test")
    assert score > 0.75 if task == "sign" else score < 0.02
    with pytest.raises(ValueError, match="seq_len"):
        trees.sequence_model(dataset(planted, task), {"seq_len": 3})


def test_lifted_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    z = np.array([r["lifted"] for r in lifted(df, ["a", "b", "c"], 4000, 0.2).orderBy("i").collect()])
    kernel = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.1


@pytest.mark.parametrize("hinge", [False, True])
def test_margin_fit_equals_a_plain_solver(spark, hinge):
    """Loss and coefficients are those of averaged subgradient descent in numpy."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 4))
    y = x @ [1.0, -0.5, 0.0, 0.25] + 0.3 + rng.standard_t(2, size=1000) * 0.3
    y = np.where(y > 0.2, 1.0, -1.0) if hinge else y
    rows = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "_lifted array<double>, _label double").repartition(3)
    coef, rounds = margin_fit(rows, 4, 0.01, hinge=hinge, epsilon=0.2, tolerance=1e-6)

    def loss(w):
        f = x @ w[:-1] + w[-1]
        each = np.maximum(1 - y * f, 0) if hinge else np.maximum(np.abs(y - f) - 0.2, 0)
        return each.mean() + 0.005 * w[:-1] @ w[:-1]

    w, tail, z = np.zeros(5), np.zeros(5), np.concatenate([x, np.ones((1000, 1))], axis=1)
    for step in range(20_000):
        f = z @ w
        slope = -y * (y * f < 1) if hinge else np.sign(f - y) * (np.abs(f - y) > 0.2)
        w = w - 100.0 / (step + 200) * (z.T @ slope / 1000 + 0.01 * np.append(w[:-1], 0))
        tail += w / 10_000 * (step >= 10_000)
    assert loss(coef) <= loss(tail) + 1e-4 and 2 <= rounds <= 60
    assert np.abs(coef - tail).max() < 0.02
    with pytest.raises(ValueError, match="no training rows"):
        margin_fit(rows.limit(0), 4, 0.01)


def test_a_kernel_model_can_be_stored(spark, planted, tmp_path):
    fitted = rbf_regression(dataset(planted, "price"), {"components": 20})
    model, _ = load_model(spark, save_model(spark, fitted.model, str(tmp_path / "k"), {}))
    one = spark.createDataFrame([([0.1] * 20,)], "_lifted array<double>")
    assert model.transform(one).first()["prediction"] == pytest.approx(fitted.model.transform(one).first()["prediction"])


def test_registry_reports_failures_as_rows(planted):
    def broken(data, params):
        raise RuntimeError("no such solver")

    registry = {
        "forest": Entry(trees.random_forest, "sign", "a forest", {"n_estimators_options": (5,), "max_depth": 3}),
        "arx": Entry(arx_model, "price", "a regression", {"exog": ("signal",), "P": 0}),
        "broken": Entry(broken, "sign", "fails"),
    }
    got = run_models(planted, registry, make=lambda raw, task, **_: dataset(planted, task))
    table = {r["model_name"]: r for r in got.collect()}
    assert "no such solver" in table["broken"]["error"] and table["broken"]["base_accuracy"] is None
    assert table["forest"]["base_accuracy"] > 0.8 and table["forest"]["error"] is None and table["forest"]["base_mae"] is None
    assert table["arx"]["base_mae"] < 0.01 and table["arx"]["trading_sharpe"] > 5
    best = {r["metric"]: r["best_model"] for r in best_by_metric(got).collect()}
    assert best["base_accuracy"] == "forest" and best["base_mae"] == "arx"


def test_contract_is_checked(planted):
    with pytest.raises(ContractError, match="y_pred"):
        check_contract(planted.withColumn("y_target", F.lit(0)))


def test_search_marks_one_best_draw(planted):
    space = {"n_estimators_options": [(3,)], "max_depth": (1, 4), "min_samples_leaf": [1, 60]}
    got = hyperparameter_search(dataset(planted, "sign"), trees.random_forest, space, draws=3, folds=2).collect()
    assert len(got) == 3 and sum(r["is_best"] for r in got) == 1
    assert max(r["score"] for r in got) == next(r["score"] for r in got if r["is_best"])
    assert draw_params(space, 5) == draw_params(space, 5)


def test_search_by_densities_beats_random_draws():
    """A planted surface over all kinds of hyperparameters: most seeds end nearer to its peak than random draws of the same count."""
    space = {"rate": ("log", 1e-4, 1.0), "depth": (2, 20), "share": (0.0, 1.0), "kind": ["a", "b", "c", "d"]}

    def surface(p):
        return -(np.log10(p["rate"]) + 2) ** 2 - ((p["depth"] - 7) / 6) ** 2 - 4 * (p["share"] - 0.8) ** 2 - (p["kind"] != "c")

    def run(seed, sign=1.0):
        return searched(space, 50, lambda ps: [sign * surface(p) for p in ps], higher=sign > 0, seed=seed)

    found = [max(s for _, s in run(seed)) for seed in range(20)]
    plain = [max(map(surface, draw_params(space, 50, seed))) for seed in range(20)]
    assert sum(a > b for a, b in zip(found, plain)) >= 16 and np.median(found) > np.median(plain) / 2
    assert run(3) == run(3) and [p for p, _ in run(3)] == [p for p, _ in run(3, -1.0)]
    for p, _ in run(5):
        assert 1e-4 <= p["rate"] <= 1.0 and 2 <= p["depth"] <= 20 and isinstance(p["depth"], int) and 0 <= p["share"] <= 1 and p["kind"] in "abcd"
    assert len(searched({"x": (1, 1), "y": [7]}, 20, lambda ps: [0.0] * len(ps), higher=True)) == 20


def test_a_stored_model_predicts_the_same(spark, planted, tmp_path):
    data = dataset(planted, "price")
    fitted = trees.random_forest(data, {"n_estimators_options": (3,), "max_depth": 3})
    path = save_model(spark, fitted.model, str(tmp_path / "m"), {"name": "forest", "mae": 0.1})
    model, about = load_model(spark, path)
    assert about == {"name": "forest", "mae": 0.1}
    again = {(r["series_id"], r["idx"]): r["prediction"] for r in model.transform(data.rows.filter("split = 'test'")).collect()}
    first = {(r["series_id"], r["idx"]): r["y_pred"] for r in fitted.predictions.filter("split = 'test'").collect()}
    assert again == pytest.approx(first)


def test_registered_model_queries_run_the_library_defaults(monkeypatch, planted):
    from gridtide.catalog import model_queries as queries

    class Seen(Exception):
        pass

    def record(*args, **options):
        raise Seen(args, options)

    for name in ("run_models", "hyperparameter_search", "seq_len_sweep", "random_forest"):
        monkeypatch.setattr(queries, name, record)
    monkeypatch.setattr(queries, "market", lambda spark, sf: planted)
    monkeypatch.setattr(queries, "_data", lambda *args, **options: planted)
    given = {}
    for name in ("model_registry_run", "hyperparameter_search", "seq_len_sweep", "feature_importance_topn", "model_store"):
        with pytest.raises(Seen) as seen:
            queries.QUERIES[name](None, "")
        given[name] = seen.value.args
    assert given["model_registry_run"] == ((planted,), {}) == given["seq_len_sweep"]
    assert given["hyperparameter_search"][0][:1] == (planted,) and given["hyperparameter_search"][1] == {}
    assert given["feature_importance_topn"] == ((planted, {}), {}) == given["model_store"]


@pytest.mark.parametrize("task", ["sign", "price"])
def test_boosting_goes_on_while_validation_rows_gain(planted, task):
    assert trees.best_prefix([3, 2, 2, 1, 4, 4, 0], 2) == (4, True) and trees.best_prefix([3, 2, 2], 2) == (2, False)
    params = {"n_estimators": 40, "max_depth": 2, "early_stopping_rounds": 10, "colsample": "all"}
    fitted = trees.gradient_boosting(dataset(planted, task), params)
    model = fitted.model.stages[-1]
    assert fitted.params["trees"] == model.getNumTrees > 5 and model.numFeatures == 2
    assert fitted.predictions.filter("y_pred IS NULL").count() == 0


def order_dependent(spark, task):
    """A state that forgets, and turns its sign where a second input is high: what counts is the order of the steps."""
    rng = np.random.default_rng(21)
    data = []
    for key in "ab":
        x = rng.standard_normal((900, 4))
        state = 0.0
        for i in range(900):
            state = 0.8 * (-state if x[i, 1] > 0.8 else state) + x[i, 0]
            split = "train" if i < 600 else "val" if i < 750 else "test"
            data.append((key, i, split, *map(float, x[i]), float(state)))
    df = spark.createDataFrame(data, "series_id string, idx long, split string, a double, b double, c double, d double, ret_fwd double")
    df = df.withColumn("trade_date", F.date_from_unix_date(F.col("idx").cast("int")))
    target = {"price": F.col("ret_fwd"), "sign": (F.col("ret_fwd") > 0).cast("int"),
              "sign_3class": F.when(F.col("ret_fwd") > 0.7, 2).when(F.col("ret_fwd") < -0.7, 0).otherwise(1)}[task]
    from gridtide.operators.sequences import sequences_same

    names = ("a", "b", "c", "d")
    return Dataset(sequences_same(df.withColumn("y_target", target), names, 20), names, task)


@pytest.mark.parametrize("task", ["sign", "price", "sign_3class"])
def test_reservoir_learns_what_depends_on_the_order(spark, task):
    from gridtide.models.recurrent import reservoir_model

    data = order_dependent(spark, task)
    fitted = reservoir_model(data, {"units": 100})
    assert set(CONTRACT) <= set(fitted.predictions.columns)
    score = held_out_score(fitted.predictions, task, "test")
    flat = held_out_score(trees.sequence_model(data, {"seq_len": 20}).predictions, task, "test")
    if task == "price":
        assert score < flat and score < 0.75 * held_out_score(fitted.predictions.withColumn("y_pred", F.lit(0.0)), task, "test")
    else:
        assert score > flat + 0.05
    again = {(r["series_id"], r["idx"]): r["y_pred"] for r in reservoir_model(data, {"units": 100}).predictions.collect()}
    assert all(abs(again[r["series_id"], r["idx"]] - r["y_pred"]) < 1e-9 for r in fitted.predictions.collect())
    if task == "sign":
        assert fitted.predictions.filter("y_pred < 0 OR y_pred > 1").count() == 0


def test_reservoir_sums_equal_numpy_and_bear_missing_inputs(spark):
    from gridtide.models.recurrent import Reservoir, input_scale, readout_sums, reservoir_model

    data = order_dependent(spark, "price")
    rows = data.rows.withColumn("seq", F.when(F.col("idx") == 500, F.transform("seq", lambda s: F.transform(s, lambda v: F.lit(None).cast("double")))).otherwise(F.col("seq")))
    some = rows.filter("idx < 100 AND split = 'train'")
    x = np.array([r["seq"] for r in some.orderBy("series_id", "idx").collect()])
    y = np.array([r["y_target"] for r in some.orderBy("series_id", "idx").collect()])
    mean, spread = input_scale(some, 4)
    assert np.allclose(mean, x.reshape(-1, 4).mean(axis=0)) and np.allclose(spread, x.reshape(-1, 4).std(axis=0))
    reservoir = Reservoir.drawn(4, 10)
    a, b, yy, n = readout_sums(some.repartition(3), reservoir, mean, spread, 1)["train"]
    z = reservoir.design((x - mean) / spread)
    assert np.allclose(a, z.T @ z) and np.allclose(b[:, 0], z.T @ y) and np.isclose(yy, y @ y) and n == len(y)
    found = reservoir_model(Dataset(rows, data.features, "price"), {}).predictions
    assert found.filter("y_pred IS NULL OR isnan(y_pred)").count() == 0
    with pytest.raises(ValueError, match="no training"):
        reservoir_model(Dataset(rows.filter("split = 'test'"), data.features, "price"), {})
