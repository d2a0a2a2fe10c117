"""Every registered query against its SQL, at the smallest scale; those without SQL must give rows."""

import pytest

from barloom import queries as core
from tests.oracle_run import compare, duck

DIRECTORY = "/root/testdata/sf0.001"
SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(DIRECTORY)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    fn = core.queries()[name]
    if name in SQL:
        assert compare(spark, con, DIRECTORY, fn, SQL[name]) == ""
    else:
        assert fn(spark, DIRECTORY).limit(1).count() == 1
