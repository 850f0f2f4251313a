"""Every registered query of the library's own operators against its SQL."""

import pytest

from lectern.plans.catalogue import ORACLES, QUERIES
from tests.compare import connect, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [*QUERIES])
def test_query(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, FOLDER))
    if name in ORACLES:
        assert (names, rows) == sql_rows(con, ORACLES[name])
    else:
        assert names


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
