import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridtide.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridtide-tests-"))
    yield session


@pytest.fixture(scope="session")
def market(spark):
    from gridtide.catalog import inputs

    return inputs.market(spark, SF).cache()


@pytest.fixture(scope="session")
def priced(market):
    return market.filter("price > 0").select("series_id", "trade_date", "price", "volume", "gas_price", "pjm_load", "temperature").cache()


def rows(df, *sort, places=8):
    """Sorted rows as plain tuples with rounded floats."""
    def plain(v):
        if isinstance(v, float):
            return round(v, places) + 0.0
        if isinstance(v, list):
            return tuple(plain(x) for x in v)
        return v

    names = sorted(df.columns)
    out = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    return sorted(out, key=repr)
