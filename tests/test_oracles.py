"""Every registered query of the core operators against its SQL, on the smallest tables."""

import pytest

from tests.oracle import assert_same, connect
from tidewatch.plans.catalog import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], ORACLE_SQL[name], SF_DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns
    df.count()
