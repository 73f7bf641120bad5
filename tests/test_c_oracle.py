"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as contract

SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def duck(folder):
    return compare.connection(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, folder, name):
    assert compare.differences(QUERIES[name](spark, folder), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
