"""Every query against its SQL twin over the same tables."""

import pytest
from compare import connection, difference
from rows import SF_DIR

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_entry(spark):
    answer = entry.entry(spark).collect()
    assert len(answer) == 1 and answer[0]["count"] > 0
