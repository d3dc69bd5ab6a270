"""Every query of the engine against its DuckDB twin."""

import pytest

from millrace.plans import catalog
from tests.compare import connect, normal


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_duckdb(spark, sf, con, name):
    got = normal(catalog.QUERIES[name](spark, sf).toPandas())
    want = normal(con.execute(catalog.ORACLES[name]).fetch_df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry_gives_rows(spark, sf):
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, sf).columns == ["id", "user_id", "date_scanned", "overall_score", "tier", "src"]
