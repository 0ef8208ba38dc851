"""Every catalogue query against its SQL, on the smallest tables."""

import os

import pytest

from pitpanel.catalog import catalog
from tools.check_oracle import compare, connect

SF = os.environ.get("PITPANEL_SF", "/root/testdata/sf0.001")
QUERIES = catalog()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict = compare(QUERIES[name], spark, con, SF)
    assert verdict.startswith(("ok", "rows only (")), verdict
    assert verdict != "rows only (0)"


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert len(set(entry.oracle_sql()) & set(QUERIES)) >= 0.9 * len(QUERIES) - 1
    df = entry.entry(spark)
    assert df.columns == ["grouping", "day_type", "unit", "model", "n", "mae", "rmse", "bias", "mape_pct"]
