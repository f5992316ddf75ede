"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare, oracle
from checks.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_registered_names():
    assert set(SQL) == set(QUERIES)
    assert QUERIES.items() <= contract.queries().items() and SQL.items() <= contract.oracle_sql().items()


def test_entry(spark):
    assert [r.severity for r in contract.entry(spark).collect()][0] == "critical"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    assert compare(spark, con, name, SF).startswith("same")
