"""The registered queries: every one has a schema, and a sample of them equals its SQL."""

import os
import sys

import pytest
from conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracles import compare, database  # noqa: E402

from gridtide.catalog import registered  # noqa: E402
from gridtide.catalog.inputs import rounded  # noqa: E402

SAMPLE = ("backtest_report", "bos_balance", "feature_frame_v2", "backtest_lines", "lines_features", "roc_curve", "threshold_sweep",
          "events_rolling_arx", "balance_downsample", "scan_market_csv", "scan_market_csv_wide", "roc_curve_groups", "arx_forecast", "arx_order_select",
          "stationarity_test", "evaluate_model_outputs_3class")


def test_every_query_has_its_sql():
    queries, oracles = registered()
    assert set(oracles) == set(queries) and len(queries) > 160
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_results_can_be_written(spark, tmp_path):
    """No two columns of a result share a name."""
    for name, query in registered()[0].items():
        if name.startswith("arx") or name.startswith("stationarity"):
            names = [c.lower() for c in query(spark, SF).columns]
            assert len(set(names)) == len(names), name


def test_entry(spark):
    got = {r["series_id"]: r["total_trades"] for r in contract.entry(spark).collect()}
    assert set(got) == {"A", "N", "R"} and all(n > 500 for n in got.values())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    text, ok = compare(spark, database(SF), SF, name, contract.queries()[name], contract.oracle_sql()[name])
    assert ok, text


@pytest.mark.parametrize("name", ("detect_trend",))
def test_trend_equals_its_sql(spark, name):
    text, ok = compare(spark, database(SF), SF, name, contract.queries()[name], contract.oracle_sql()[name])
    assert ok, text


@pytest.mark.parametrize("name", ("recent_high_low",))
def test_high_and_low_equal_their_sql(spark, name):
    text, ok = compare(spark, database(SF), SF, name, contract.queries()[name], contract.oracle_sql()[name])
    assert ok, text


def test_halves_are_rounded_as_in_the_sql(spark):
    given = [1669.66575, 2341.47665, -1669.66575, 0.00005, 2.5, 1e15 + 0.3, float("inf"), None]
    told = [r[0] for r in rounded(spark.createDataFrame([(x,) for x in given], "x double").coalesce(1), 4).collect()]
    con = database(SF)
    assert told == [con.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0] for x in given]
