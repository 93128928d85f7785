"""Every query of the library against its DuckDB SQL."""

import pytest
from oracle import compare, connect

from trailmark import queries as q

QUERIES, ORACLES = q.queries(), q.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    compare(con, QUERIES[name](spark, sf), ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
