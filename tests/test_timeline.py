"""Blocks with copied neighbours give the same answers as whole series."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridtide.operators import cleaning as C
from gridtide.operators import curves as R
from gridtide.operators import scaling as Z
from gridtide.operators import scoring as M
from gridtide.operators import features as X
from gridtide.operators import sequences as Q
from gridtide.operators import strategies as S
from gridtide.operators import targets as Y
from gridtide.operators import trading as T
from gridtide.plans.attach import attach
from gridtide.plans.running import running_sums
from gridtide.plans import timeline
from gridtide.plans.timeline import DAILY, SeriesFrame, SeriesOrder, with_index

SMALL = SeriesOrder(block_rows=40)
TINY = SeriesOrder(block_rows=7)


@pytest.fixture(scope="module")
def uneven(spark):
    """One long series with bursts and gaps, one short one, and one of a single row."""
    rng = random.Random(5)
    out, day = [], dt.date(2001, 1, 1)
    for i in range(700):
        day += dt.timedelta(days=1 if rng.random() < 0.8 else rng.choice([2, 45, 200]))
        price = None if rng.random() < 0.1 else 100 + 30 * rng.random() * (1 + i % 5)
        out.append(("long", day, price))
    out += [("short", dt.date(2001, 1, 1) + dt.timedelta(days=i), 50.0 + i * (-1) ** i) for i in range(9)]
    out.append(("one", dt.date(2003, 3, 3), 5.0))
    return spark.createDataFrame(out, "series_id string, trade_date date, price double").cache()


CASES = {
    "index": lambda d, o: with_index(d, o),
    "lags": lambda d, o: X.lag_features(d, ["price"], (1, 2, 9), order=o),
    "mean": lambda d, o: X.rolling_mean(d, ["price"], 30, order=o),
    "volatility": lambda d, o: X.volatility(d, order=o),
    "slope": lambda d, o: X.trend_slope(d, order=o),
    "forward": lambda d, o: Y.forward_return(d, horizon=5, order=o),
    "fill": lambda d, o: C.forward_fill(d, ["price"], o),
    "backfill": lambda d, o: C.backward_fill(d, ["price"], o),
    "split": lambda d, o: Y.split_chronological(d, order=o),
    "rolling_split": lambda d, o: Y.split_rolling_window(d, 0.4, order=o),
    "folds": lambda d, o: Y.time_series_folds(d, 3, order=o),
    "sequences": lambda d, o: Q.sequences_next(Y.split_chronological(d, order=o), ["price"], 5, order=o),
    "zero_change": lambda d, o: C.drop_zero_change(d, order=o),
}


@pytest.mark.parametrize("order", [DAILY, SMALL], ids=["whole", "blocks40"])
@pytest.mark.parametrize("window", [2, 14, 90, 1000])
def test_long_windows_are_ranked_as_short_ones_are_sorted(uneven, order, window, monkeypatch):
    given = uneven.withColumn("price", F.when(F.col("trade_date") < "2015-01-01", F.coalesce("price", F.lit(7.0))).otherwise(F.col("price")))
    given = given.withColumns({"n": F.lit(None).cast("string")})
    told = []
    for longest in (0, 10_000):
        monkeypatch.setattr(S, "SORTED_WINDOW", longest)
        told.append((rows(S.rolling_percentile(given, window, 12.5, 90, order=order)),
                     rows(S.percentile_strategy(given.drop("n"), window, order=order))))
    assert told[0] == told[1]
    assert window == 1000 or any(r[2] is not None for r in told[0][0])
    assert S.rolling_percentile(given.limit(0), 90).collect() == []


@pytest.mark.parametrize("order", [SMALL, TINY], ids=["blocks40", "blocks7"])
@pytest.mark.parametrize("name", CASES)
def test_blocks_equal_whole_series(uneven, name, order):
    rows_in = uneven.filter("price IS NOT NULL") if name in ("sequences", "zero_change") else uneven
    assert rows(CASES[name](rows_in, order)) == rows(CASES[name](rows_in, DAILY))


STRATEGIES = {
    "percentile": lambda d, o: S.percentile_strategy(d, order=o),
    "bos": lambda d, o: S.bos_strategy(d, order=o),
    "balance": lambda d, o: S.bos_balance(d, order=o),
    "credited": lambda d, o: S.bos_balance(d, short_model="credited", order=o),
    "curve": lambda d, o: T.cumulative_return_curve(T.strategy_returns(S.percentile_strategy(d, order=o), order=o), order=o),
}


@pytest.mark.parametrize("name", STRATEGIES)
def test_strategies_in_blocks(priced, name):
    prices = priced.filter("trade_date < DATE '1996-06-01'").select("series_id", "trade_date", "price")
    order = SeriesOrder(block_rows=60)
    whole, blocked = rows(STRATEGIES[name](prices, DAILY), places=6), rows(STRATEGIES[name](prices, order), places=6)
    assert len(whole) == len(blocked)
    for a, b in zip(whole, blocked):
        assert a == pytest.approx(b, rel=1e-9) if all(isinstance(v, float) for v in a) else _close(a, b)


def _close(a, b):
    return all(x == pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_a_block_gets_no_more_rows_than_it_needs(uneven):
    frame = SeriesFrame.open(uneven, SeriesOrder(block_rows=50), lookback=5)
    sizes = {r["_block"]: r["n"] for r in frame.df.filter("series_id = 'long'").groupBy("_block").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) >= 12
    assert max(sizes.values()) <= 50 + 31 + 5 + 31  # a block, the rest of its last month, and the months its lookback touches
    assert frame.df.filter("_own").count() == uneven.count()


def test_timestamps_with_ties(spark):
    at = dt.datetime(2020, 1, 1)
    data = [("a", at + dt.timedelta(seconds=i // 3), i, float(i * i % 17)) for i in range(600)]
    df = spark.createDataFrame(data, "k string, ts timestamp, id long, v double")
    order = SeriesOrder(keys=("k",), ts="ts", tie=("id",), block_rows=50, bucket_at=3)
    got = R.rolling_residual_mean(df, 20, residual="v", order=order).withColumnRenamed("rolling_mean", "m")
    expected = {i: sum(float(j * j % 17) for j in range(i - 19, i + 1)) / 20 for i in range(19, 600)}
    found = {r["id"]: r["m"] for r in got.collect()}
    assert len(found) == 600
    assert all(found[i] == pytest.approx(v) for i, v in expected.items()) and found[18] is None


def test_many_rows_at_one_time_are_split_by_the_tie(spark, monkeypatch):
    import gridtide.plans.timeline as timeline

    monkeypatch.setattr(timeline, "BUCKET_ROWS", 100)
    monkeypatch.setattr(timeline, "TIE_WIDTHS", (1000, 50))
    df = spark.range(500).select(F.lit("a").alias("k"), F.lit("2020-01-01").cast("date").alias("d"), F.col("id"))
    order = SeriesOrder(keys=("k",), ts="d", tie=("id",), block_rows=100)
    frame = SeriesFrame.open(df, order, lookback=3).index("place")
    assert frame.df.select("_block").distinct().count() == 5
    assert frame.close().filter("place <> id").count() == 0


def test_running_sums_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))  # a NULL group
    parts = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "g", "v").select(F.spark_partition_id().alias("p"))
    assert parts.distinct().count() > 1
    got = running_sums(df, [F.col("v")], {"s": F.col("v")}, keys=["g"])
    by_group = {}
    for r in sorted(df.collect(), key=lambda r: (r["g"] or 0, r["v"])):
        by_group[r["g"], r["v"]] = by_group.get((r["g"], "sum"), 0) + r["v"]
        by_group[r["g"], "sum"] = by_group[r["g"], r["v"]]
    assert all(by_group[r["g"], r["v"]] == r["s"] for r in got.collect())
    assert got.count() == 1000


def test_attach_keeps_rows_of_unknown_keys(spark):
    big = spark.range(100).select((F.col("id") % 4).alias("k"), "id")
    stats = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("s"))
    got = attach(big, stats, ["k"])
    assert got.count() == 100 and got.filter("s IS NULL").count() == 25


@pytest.mark.parametrize("order", [DAILY, SMALL], ids=["whole", "blocks40"])
def test_rows_without_a_time_come_last(uneven, spark, order):
    odd = uneven.unionByName(spark.createDataFrame([("long", None, 1.0)], uneven.schema))
    got = with_index(odd, order)
    assert got.count() == uneven.count() + 1
    assert got.filter("trade_date IS NULL").first()["idx"] == 700
    filled = C.backward_fill(odd, ["price"], order).filter("price IS NULL").count()
    assert filled == 0


@pytest.fixture(scope="module")
def nameless(uneven, spark):
    """The long series again under no name."""
    again = uneven.filter("series_id = 'long'").withColumn("series_id", F.lit(None).cast("string"))
    return uneven.unionByName(again).cache()


NULL_KEYS = {**CASES, "balance": lambda d, o: S.bos_balance(d.filter("price IS NOT NULL"), order=o),
             "scale": lambda d, o: Z.standard_scale(Y.split_chronological(d, order=o), ["price"], order=o),
             "minmax": lambda d, o: Z.minmax_scale(Y.split_chronological(d, order=o), ["price"], order=o),
             "zero_price": lambda d, o: C.replace_zero_price(d.withColumn("price", F.when(F.col("price") < 110, 0.0).otherwise(F.col("price"))), order=o)}


@pytest.mark.parametrize("name", NULL_KEYS)
def test_a_series_without_a_name_is_a_series(nameless, name):
    rows_in = nameless.filter("price IS NOT NULL") if name in ("sequences", "zero_change") else nameless
    blocks = SeriesFrame.open(rows_in, SMALL).df.filter("series_id IS NULL").select("_block").distinct().count()
    assert blocks > 5
    alone = rows_in.filter("series_id = 'long'").withColumn("series_id", F.lit(None).cast("string"))
    named = rows(NULL_KEYS[name](alone, DAILY), places=6)
    got = rows(NULL_KEYS[name](rows_in, SMALL).filter("series_id IS NULL"), places=6)
    assert len(got) == len(named)
    assert all(_same(x, y) for x, y in zip(sorted(got, key=_plain), sorted(named, key=_plain)))


def _same(x, y):
    """Equal up to the last of six decimals, lists within lists too."""
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(_same(a, b) for a, b in zip(x, y))
    return x == pytest.approx(y, rel=1e-9, abs=2e-6) if isinstance(x, float) and y is not None else x == y


def _plain(row):
    return repr([v for v in row if not isinstance(v, (float, tuple))])


def test_groups_without_a_name_are_scored(spark):
    df = spark.range(3000).select((F.col("id") % 7 > 3).cast("int").alias("y"), (F.hash("id") % 1000 / 1000).alias("p"),
                                  F.when(F.col("id") % 2 == 0, "x").alias("g"))
    for score in (M.roc_auc, R.pr_auc, M.classification_metrics, lambda d, **k: M.evaluate_model_outputs(d.withColumn("ret_fwd", F.col("p")), "sign", y="y", pred="p", **k)):
        got = {r["g"]: [r[c] for c in r.asDict() if c != "g"] for r in score(df, by=["g"]).collect()}
        for g in ("x", None):
            alone = [r for r in score(df.filter(F.col("g").eqNullSafe(F.lit(g)))).collect()][0]
            assert got[g] == pytest.approx(list(alone)) if all(isinstance(v, float) for v in alone) else got[g] == list(alone)
    curve = R.roc_curve(df, by=["g"]).filter("g IS NULL")
    assert curve.agg(F.max("fpr")).first()[0] == 1.0


def test_a_window_s_values_are_collected_once(uneven):
    plan = S.rolling_percentile(uneven, 14, order=DAILY)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1


def test_buckets_are_counted_only_where_finer_ones_divide_them(spark, monkeypatch):
    """Days at midnight, which no hour or second divides, in several shapes; the choice is that of counting every candidate."""
    monkeypatch.setattr(timeline, "BUCKET_ROWS", 8)
    data = [("s", dt.datetime(2001, 1, 1 + i % 5), i * 700_000) for i in range(100)] + [("s", None, i) for i in range(3)]
    order = SeriesOrder(("k",), "ts", ("id",))
    for given in (data, data[:20], [("s", dt.datetime(2001, 1, 1, i % 24), i) for i in range(100)], [("s", None, 7)] * 20, [],
                  [("s", dt.datetime(2001, 1, 1), 1_500 * i) for i in range(50)], [(None, dt.datetime(2001, 1, 1, 0, 0, 0, i), i) for i in range(50)]):
        df = spark.createDataFrame(given, "k string, ts timestamp, id long").coalesce(1)
        found = timeline._candidates(df, order)
        fullest = [df.groupBy("k", c.alias("b")).count().agg(F.max("count")).first()[0] or 0 for c in found]
        counted, group = [], type(df).groupBy
        monkeypatch.setattr(type(df), "groupBy", lambda self, *by: (by and counted.append(by)) or group(self, *by))
        assert order.resolved(df).bucket_at == next((i for i, n in enumerate(fullest) if n <= 8), len(found) - 1)
        monkeypatch.setattr(type(df), "groupBy", group)
        assert len(counted) <= 3
        assert given is not data or (fullest[:6] == [20] * 6 and len(counted) == 2)


def test_carried_states_read_written_rows(priced):
    """What a running state is put together from is computed once, not again by whoever reads the result."""
    prices = priced.filter("trade_date < DATE '1995-09-01'").select("series_id", "trade_date", "price")
    for strategy in (S.percentile_strategy, S.bos_strategy):
        held = strategy(prices, order=SeriesOrder(block_rows=60))
        assert "Window" not in held._jdf.queryExecution().optimizedPlan().toString()
        assert rows(held.select("trade_date", "signal", "position")) == rows(strategy(prices).select("trade_date", "signal", "position"))
