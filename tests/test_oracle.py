"""Every registered query against its SQL at the smallest size."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference, oracle
from conftest import SF

QUERIES, TEXTS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in TEXTS:
        assert difference(spark, con, name, QUERIES[name], TEXTS[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
