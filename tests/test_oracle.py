"""Every key with oracle SQL agrees with DuckDB on the smallest scale (the
driver's gate runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as entry
from tools.oracle_check import duck, frame_hash

SF = "/root/testdata/sf0.001"
KEYS = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_key_is_registered():
    assert set(KEYS) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, con, key):
    sp = entry.queries()[key](spark, SF).toPandas()
    dk = con.execute(entry.oracle_sql()[key]).df()
    assert frame_hash(sp) == frame_hash(dk)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "revenue_share_pct" in df.columns
