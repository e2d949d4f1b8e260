"""Operators against literal values and row loops."""

import json

import numpy as np
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from gridtide.catalog import inputs
from gridtide.functions import scalars as U
from gridtide.functions.ranks import sliding_percentiles
from gridtide.operators import cleaning as C
from gridtide.operators import curves as R
from gridtide.operators import features as X
from gridtide.operators import scaling as Z
from gridtide.operators import scoring as M
from gridtide.operators import sequences as Q
from gridtide.operators import statistics as A
from gridtide.operators import strategies as S
from gridtide.operators import targets as Y
from gridtide.operators import trading as T
from gridtide.plans.dataset import make_dataset
from gridtide.plans.timeline import SeriesOrder
from gridtide.sources import market as K
from gridtide.sources.results import ExperimentStore, NotStored

# Fixed test values: small vectors and confusion counts whose scores are published.
Y_REG = [0.01, -0.02, 0.03, -0.01, 0.02, 0.00, -0.015, 0.025]
P_REG = [0.012, -0.018, 0.028, -0.015, 0.022, 0.002, -0.012, 0.023]
Y_CLS = [1, 0, 1, 1, 0, 1, 0, 0, 1, 1]
P_CLS = [0.8, 0.3, 0.6, 0.9, 0.2, 0.7, 0.4, 0.1, 0.85, 0.95]
P_RET = [0.015, -0.01, 0.025, 0.005, 0.018, -0.002, -0.01, 0.02]
COUNTS = [(644, 163, 179, 203, (0.712363, 0.5546, 0.5314, 0.5428)), (751, 56, 297, 85, (0.703112, None, None, None)), (807, 0, 382, 0, (0.678722, 0.0, 0.0, 0.0))]
# End of fixed test values.


def frame(spark, schema, data):
    return spark.createDataFrame(list(data), schema)


def test_sliding_percentiles_equal_numpy():
    rng = np.random.default_rng(7)
    for count, window in ((1, 1), (5, 5), (60, 7), (300, 64), (50, 51)):
        for values in (rng.normal(size=count), rng.integers(0, 3, count).astype(float), np.zeros(count)):
            got = sliding_percentiles(values, window, (0, 20, 80, 100))
            assert np.isnan(got[:, : window - 1]).all()
            for i in range(window - 1, count):
                assert got[:, i] == pytest.approx(np.percentile(values[i - window + 1: i + 1], (0, 20, 80, 100)))


def test_regression_golden(spark):
    df = frame(spark, "y_true double, y_pred double", zip(Y_REG, P_REG))
    got = M.regression_metrics(df).first()
    assert got["mae"] == pytest.approx(0.0025) and got["mse"] == pytest.approx(7.25e-06)
    assert got["rmse"] == pytest.approx(0.002692582, abs=1e-9) and got["mape"] is None
    assert M.r2_score(df).first()[0] == pytest.approx(0.977254902, abs=1e-9)


def test_classification_golden(spark):
    df = frame(spark, "y int, p double", zip(Y_CLS, P_CLS))
    got = M.classification_metrics(df).first()
    assert [got[m] for m in ("accuracy", "precision", "recall", "f1")] == [1.0] * 4
    assert (got["tn"], got["fp"], got["fn"], got["tp"]) == (4, 0, 0, 6)
    assert M.roc_auc(df).first()[0] == 1.0


@pytest.mark.parametrize("tn,fp,fn,tp,expected", COUNTS)
def test_metrics_of_a_confusion_matrix(spark, tn, fp, fn, tp, expected):
    cells = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    df = frame(spark, "y int, p int, n int", cells).select("y", "p", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))), "n").filter("n > 0")
    got = M.classification_metrics(df).first()
    for name, value in zip(("accuracy", "precision", "recall", "f1"), expected):
        assert value is None or got[name] == pytest.approx(value, abs=1e-4)


@pytest.mark.parametrize("rule,expected", [("sign", (0.11, 0.75, 0.01375, 17.549929, 8)), ("threshold", (0.075, 0.5, 0.009375, 11.163126, 8))])
def test_trading_golden(spark, rule, expected):
    got = T.trading_metrics(frame(spark, "actual double, pred double", zip(Y_REG, P_RET)), rule=rule).first()
    found = [got[m] for m in ("roi", "win_rate", "avg_return", "sharpe", "total_trades")]
    assert found == pytest.approx(expected, abs=1e-6)


def test_trading_of_nothing_is_zero(spark):
    got = T.trading_metrics(frame(spark, "actual double, pred double", [(None, 1.0)])).first()
    assert tuple(got) == (0, 0.0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        T.position_from_prediction(F.lit(1.0), "always")


def test_cumulative_golden(spark):
    data = [("s", f"2020-01-{i + 1:02d}", a, p) for i, (a, p) in enumerate(zip(Y_REG, P_RET))]
    df = frame(spark, "series_id string, d string, actual double, pred double", data).withColumn("trade_date", F.col("d").cast("date"))
    got = T.trading_frame(df).orderBy("trade_date").collect()
    assert [r["cumulative_return"] for r in got] == pytest.approx(
        [0.01, 0.0302, 0.061106, 0.05049494, 0.071504839, 0.071504839, 0.087577411, 0.114766847], abs=1e-8)
    assert got[-1]["cumulative_actual"] == pytest.approx(0.039393835, abs=1e-8)


def prices(priced, key="R"):
    return [r["price"] for r in priced.filter(F.col("series_id") == key).orderBy("trade_date").collect()]


def test_percentile_strategy_equals_a_loop(priced):
    p = prices(priced)
    held, expected = 0, []
    for i, now in enumerate(p):
        signal = 0
        if i >= 14:
            low, high = np.percentile(p[i - 13 : i + 1], [20, 80])
            signal = 1 if now <= low else -1 if now >= high else 0
        held = signal or held
        expected.append((signal, held))
    got = S.percentile_strategy(priced).filter("series_id = 'R'").orderBy("trade_date").collect()
    assert [(r["signal"], r["position"]) for r in got] == expected


def test_bos_equals_a_loop(priced):
    p = prices(priced)
    cash, side, shares, expected = 10_000.0, 0, 0.0, []
    for i, now in enumerate(p):
        signal = 0
        if i >= 20:
            up, down = p[i - 1] > p[i - 5] * 1.02, p[i - 1] < p[i - 5] * 0.98
            high, low = max(p[i - 20 : i]), min(p[i - 20 : i])
            wanted = 1 if up and now > high else -1 if down and now < low else 0
            if wanted and wanted != side:
                cash = shares * now if side == 1 else cash - shares * now if side == -1 else cash
                shares, side, signal = cash / now, wanted, wanted
        worth = shares * now if side == 1 else cash - shares * now if side == -1 else cash
        expected.append((signal, side, shares, worth))
    got = S.bos_balance(priced).filter("series_id = 'R'").orderBy("trade_date").collect()
    assert [(r["signal"], r["position"]) for r in got] == [e[:2] for e in expected]
    assert [r["shares"] for r in got] == pytest.approx([e[2] for e in expected], rel=1e-7, abs=1e-7)
    assert [r["balance"] for r in got] == pytest.approx([e[3] for e in expected], rel=1e-7, abs=1e-6)


def test_strategy_parameters_are_checked(priced):
    with pytest.raises(ValueError):
        S.percentile_strategy(priced, window=1)
    with pytest.raises(ValueError):
        S.rolling_percentile(priced, low=80, high=20)
    with pytest.raises(ValueError):
        S.bos_balance(priced, short_model="free")


def daily(spark, n, key="s", price=lambda i: float(i + 1)):
    return spark.createDataFrame([(key, i, price(i)) for i in range(n)], "series_id string, i int, price double").withColumn(
        "trade_date", F.date_from_unix_date("i"))


@pytest.mark.parametrize("n,expected", [(100, (70, 15, 15)), (99, (71, 14, 14))])
def test_split_golden(spark, n, expected):
    got = {r["split"]: r["n"] for r in Y.split_counts(Y.split_chronological(daily(spark, n))).collect()}
    assert (got["train"], got["val"], got["test"]) == expected


def test_splits_are_in_order_and_scalers_only_see_training(spark):
    rows_ = Y.split_chronological(daily(spark, 100))
    ends = {r["split"]: (r["lo"], r["hi"]) for r in rows_.groupBy("split").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).collect()}
    assert ends["train"][1] < ends["val"][0] and ends["val"][1] < ends["test"][0]
    spoiled = rows_.withColumn("price", F.when(F.col("split") == "test", 1e9).otherwise(F.col("price")))
    a, b = (Z.fit_scaler(r, ["price"]).first() for r in (rows_, spoiled))
    assert a == b
    train = np.arange(1, 71)
    assert (a["price__offset"], a["price__width"]) == pytest.approx((train.mean(), train.std()))


@pytest.mark.parametrize("scale,expected", [(Z.standard_scale, 0.0), (Z.minmax_scale, 0.0)])
def test_a_constant_column_scales_to_zero(spark, scale, expected):
    got = scale(Y.split_chronological(daily(spark, 20, price=lambda i: 0.1)), ["price"])
    assert {round(r["price"], 12) for r in got.collect()} == {expected}


def test_rolling_window_that_does_not_fit(spark):
    with pytest.raises(ValueError):
        Y.split_rolling_window(daily(spark, 10), 0.9)
    got = Y.split_rolling_window(daily(spark, 100), 0.7)
    assert got.filter("split = 'train'").count() == 70


def test_sequence_counts(spark):
    rows_ = daily(spark, 20)
    assert Q.sequences_next(rows_, ["price"], split=None).count() == 6
    assert Q.sequences_same(rows_, ["price"], split=None).count() == 7
    first = Q.sequences_next(rows_, ["price"], split=None).orderBy("i").first()
    assert first["i"] == 14 and [s[0] for s in first["seq"]] == [float(v) for v in range(1, 15)]


def test_downsampling_keeps_whole_small_classes(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y_target"))
    got = Y.balance_downsample(df, key=["k"])
    counts = {r["y_target"]: r["n"] for r in got.groupBy("y_target").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 100, 1: 100}
    assert rows(got) == rows(Y.balance_downsample(df.repartition(7), key=["k"]))
    assert rows(got) != rows(Y.balance_downsample(df, key=["k"], seed=7))


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300) * 0.6 + 0.3 * y, 1)
    df = frame(spark, "y int, p double", [(int(a), float(b)) for a, b in zip(y, p)])
    pos, neg = p[y == 1], p[y == 0]
    expected = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert M.roc_auc(df).first()[0] == pytest.approx(expected)
    assert M.roc_auc(df.filter("y = 1")).first()[0] is None
    curve = sorted((r["fpr"], r["tpr"]) for r in R.roc_curve(df).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(expected)


def test_prob_or_label_rule(spark):
    labels = frame(spark, "y int, p double", [(1, 1.0), (0, 0.0), (1, 0.0)])
    assert not M.classification_metrics(labels).first()["is_probability"]
    assert M.classification_metrics(labels).first()["accuracy"] == pytest.approx(2 / 3)
    probs = frame(spark, "y int, p double", [(1, 0.5), (0, 0.2), (1, 0.51)])
    got = M.prob_or_label_rule(probs)
    assert sorted((r["p"], r["label"]) for r in got.collect()) == [(0.2, 0), (0.5, 0), (0.51, 1)]


def test_calibration_bins_are_closed_on_the_right(spark):
    df = frame(spark, "y int, p double", [(0, 0.0), (1, 0.1), (0, 0.1000001), (1, 1.0)])
    got = {r["bin"]: r["n"] for r in R.calibration_curve(df).collect()}
    assert got == {0: 2, 1: 1, 9: 1}


def test_error_by_magnitude_leaves_the_largest_out(spark):
    df = frame(spark, "y_true double, residual double", [(float(i), 1.0) for i in range(10)])
    got = R.error_by_magnitude(df).collect()
    assert sum(r["n"] for r in got) == 9 and max(r["bin"] for r in got) == 9


def test_inverse_normal(spark):
    got = spark.range(1).select(*(U.inverse_normal(F.lit(p)).alias(f"q{i}") for i, p in enumerate((0.01, 0.5, 0.975, 0.99)))).first()
    assert tuple(got) == pytest.approx((-2.3263478740408408, 0.0, 1.959963984540054, 2.3263478740408408), abs=1e-8)


def test_zero_prices_take_the_training_mean(spark):
    df = daily(spark, 20, price=lambda i: 0.0 if i in (3, 18) else float(i))
    got = C.replace_zero_price_train_only(Y.split_chronological(df, 0.2, 0.1)).filter("i IN (3, 18)").collect()
    known = [i for i in range(1, 14) if i != 3]
    assert [r["price"] for r in got] == pytest.approx([np.mean(known)] * 2)


def test_unchanged_prices(spark):
    flat = daily(spark, 6, price=lambda i: [5.0, 5.0, 6.0, 7.0, 7.0, 8.0][i])
    assert [r["i"] for r in C.drop_zero_change(flat).orderBy("i").collect()] == [2, 3, 5]
    moving = daily(spark, 4, key="m")
    assert C.drop_zero_change(moving).count() == 4


def test_quality_checks_name_what_is_wrong(spark, priced):
    assert C.assert_quality(priced, ["price", "volume"]).count() == priced.count()
    bad = daily(spark, 3).unionByName(daily(spark, 1)).withColumn("price", F.when(F.col("i") == 2, float("inf")).otherwise(F.col("price")))
    with pytest.raises(C.BadData, match="repeated_time=1.*nonfinite_price=1"):
        C.assert_quality(bad, ["price"])
    with pytest.raises(C.BadData, match="no rows"):
        C.assert_quality(bad.limit(0), ["price"])


def test_missing_columns_are_named(spark):
    with pytest.raises(K.MissingColumns, match="volume"):
        K.require_columns(daily(spark, 2), ["price", "volume"])


def test_csv_with_bad_dates_and_numbers(spark, tmp_path):
    names = ["series_id", *K.DATE_COLUMNS, *K.CORE_COLUMNS]
    lines = [",".join(f'"{n}"' for n in names), "a,2020-01-02,xx,2020-01-03,1.5,NaN,3,Infinity,", "a,nope,,,2,2,2,2,2"]
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    got = K.core_projection(K.parse_dates(K.scan_market_csv(spark, str(tmp_path)))).orderBy("price").collect()
    assert str(got[0]["trade_date"]) == "2020-01-02" and got[0]["delivery_start"] is None
    assert (got[0]["volume"], got[0]["pjm_load"], got[0]["temperature"]) == (None, None, None)
    assert got[1]["trade_date"] is None


def test_nan_in_price_is_no_price(spark):
    df = frame(spark, "x double", [(float("nan"),), (float("inf"),), (1.0,), (None,)])
    assert [r["x"] for r in C.inf_to_null(df).collect()] == [None, None, 1.0, None]


def test_experiments_round_trip(spark, tmp_path):
    store = ExperimentStore(spark, str(tmp_path))
    store.save_experiment("b", {"train": "2001..2015"}, {"RF": {"accuracy": np.float64(0.71)}}, "RF", "first")
    store.save_experiment("a", {}, {"GBT": {"mae": 1}})
    store.save_experiment("b", {"train": "2001..2016"}, {"RF": {"accuracy": 0.72}}, "RF")
    assert [r[0] for r in store.list_experiments().collect()] == ["a", "b"]
    latest = store.load_experiment("b").first()
    assert latest["models"]["RF"]["accuracy"] == 0.72 and latest["data_split"]["train"].endswith("2016")
    with pytest.raises(NotStored):
        store.load_experiment("c")
    store.save_params("svr", {"C": 10, "kernel": "rbf", "gamma": np.float64(0.5)})
    assert store.load_params("svr") == {"C": 10, "kernel": "rbf", "gamma": 0.5}
    with pytest.raises(NotStored):
        store.load_params("none")


def test_topk_takes_the_strongest(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("good"), F.lit(1.0).alias("flat"),
                                (F.col("id") % 3).cast("double").alias("weak"), (F.col("id") * 2).cast("double").alias("y_target"))
    got = A.topk_features(df, ["flat", "weak", "good"], 2).collect()
    assert [r["feature"] for r in got] == ["good", "weak"]
    assert {r["feature"]: r["abs_corr"] for r in A.feature_target_corr(df, ["flat"]).collect()} == {"flat": 0.0}


@pytest.mark.parametrize("version", [1, 2])
def test_dataset_in_blocks_is_the_same(market, version):
    part = market.filter("trade_date < DATE '1997-01-01'")
    options = {"features_version": version, "scaler": "standard"}
    whole = make_dataset(part, "sign", **options)
    blocked = make_dataset(part, "sign", order=SeriesOrder(block_rows=100), **options)
    names = ["series_id", "trade_date", "idx", "split", "y_target", "price"]
    assert rows(whole.rows.select(*names), places=6) == rows(blocked.rows.select(*names), places=6)


def test_balanced_dataset_only_drops_training_rows(market):
    plain = make_dataset(market, "sign", seq_len=5)
    even = make_dataset(market, "sign", seq_len=5, balance=True)
    count = lambda d, s: d.rows.filter(F.col("split") == s).count()
    assert count(plain, "test") == count(even, "test") and count(plain, "train") > count(even, "train")
    classes = [r["n"] for r in even.rows.filter("split = 'train'").groupBy("y_target").agg(F.count("*").alias("n")).collect()]
    assert len(set(classes)) == 1
    every = make_dataset(market, "sign", balance="all").rows.groupBy("split", "y_target").agg(F.count("*").alias("n")).collect()
    assert len(every) == 6 and len({(r["split"], r["n"]) for r in every}) == 3


def test_comparison_table_and_json(spark):
    scores = inputs.scores(spark, SF)
    got = M.baseline_classification(scores.withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test")), p="p")
    table = {r["model"]: r for r in got.collect()}
    assert set(table) == {"majority", "random", "model"} and table["model"]["auc"] > table["random"]["auc"]
    doc = spark.range(1).select(F.to_json(F.struct(F.lit(1).alias("a")))).first()[0]
    assert json.loads(doc) == {"a": 1}


def test_unlabelled_rows_are_no_class(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") >= 3, (F.col("id") % 3 == 0).cast("int")).alias("y_target"))
    counts = {r["y_target"]: r["n"] for r in Y.balance_downsample(df, key=["k"]).groupBy("y_target").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 33 - 1, 1: 33 - 1} or (set(counts) == {0, 1} and counts[0] == counts[1] >= 30)


def test_text_and_dates_drop_no_rows(priced):
    odd = priced.withColumns({"note": F.when(F.dayofmonth("trade_date") < 15, "x"), "delivery_start": F.when(F.dayofmonth("trade_date") > 15, F.col("trade_date"))})
    assert X.feature_frame_v2(odd).count() == X.feature_frame_v2(priced).count()


def test_repeated_days_are_refused(priced):
    with pytest.raises(C.BadData, match="repeated_time"):
        make_dataset(priced.unionByName(priced.limit(3)))


@pytest.mark.parametrize("task", ["sign_3class", "volatility"])
def test_other_tasks_are_scored(priced, task):
    data = make_dataset(priced, task)
    scored = M.evaluate_model_outputs(data.rows.withColumn("y_pred", F.col("y_target").cast("double")), task).first()
    if task == "sign_3class":
        assert scored["base_accuracy"] == scored["base_f1"] == 1.0 and scored["trading_win_rate"] > 0.5
        cells = json.loads(scored["base_confusion_matrix"])
        assert sum(cells[k][k] for k in range(3)) == data.rows.count()
    else:
        assert scored["base_mae"] == 0.0


def test_dates_in_several_spellings(spark):
    df = spark.createDataFrame([("2001-02-03",), ("2/3/2001",), ("2001/2/3",), ("03.02.2001",), ("x",), (None,)], "`Trade Date` string")
    got = [str(r[0]) for r in K.parse_dates(df).collect()]
    assert got == ["2001-02-03"] * 3 + ["None"] * 3
    assert str(K.parse_dates(df, formats=["dd.MM.yyyy"]).collect()[3][0]) == "2001-02-03"


def test_a_missing_core_column_is_named(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("1",)], "`Trade Date` string").write.option("header", True).csv(path)
    with pytest.raises(K.MissingColumns, match="Henry Hub"):
        K.core_projection(K.parse_dates(K.scan_market_csv(spark, path)))


def test_experiments_of_many_writers(spark, tmp_path):
    """Writers side by side lose nothing, a write without its line in the manifest is not read, and one name reads its own folders."""
    from concurrent.futures import ThreadPoolExecutor

    store = ExperimentStore(spark, str(tmp_path))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.save_experiment(f"run {i % 3}", {"at": str(i)}, {"m": {"score": float(i)}}), range(9)))
    assert [r["experiment_id"] for r in store.list_experiments().collect()] == ["run 0", "run 1", "run 2"]
    assert store._rows(store.experiments, "experiment_id string, data_split map<string,string>", "experiment_id").count() == 9
    store.save_experiment("run 1", {"at": "last"}, {})
    latest = {r["experiment_id"]: r["data_split"]["at"] for r in store.load_experiments().collect()}
    assert latest["run 1"] == "last" and store.load_experiment("run 1").first()["data_split"] == {"at": "last"}
    half = spark.createDataFrame([("run 2", {"at": "half"}, {}, None, None)], "experiment_id string, data_split map<string,string>, models map<string,map<string,double>>, best_model string, notes string")
    half.withColumn("_saved_at", F.current_timestamp()).write.partitionBy("experiment_id").json(f"{store.experiments}/data/snapshot=unfinished")
    assert store.load_experiment("run 2").first()["data_split"]["at"] != "half"
    plan = store.load_experiment("run 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(experiment_id" in plan
