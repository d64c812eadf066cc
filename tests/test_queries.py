"""Every query of the core against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from cartolith.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    con = connect(small)
    con.execute("SET TimeZone = 'UTC'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, con, name):
    assert differences(QUERIES[name](spark, small), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
