"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import pytest

import wirelake.plans as plans
from tests.oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows_as_duckdb(spark, con, name):
    rows, differs = compare(spark, con, plans.queries()[name], plans.oracle_sql()[name], SF)
    assert not differs
