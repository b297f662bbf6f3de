"""Every named query against its SQL on the same tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from quizlake.plans import catalog
from tests import oracle_check

QUERIES = {name: plan for name, plan in queries().items() if name in catalog.QUERIES}
SQL = {name: sql for name, sql in oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con(folder):
    return oracle_check.connection(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, folder, name):
    good, note = oracle_check.compare(spark, con, name, QUERIES[name], SQL.get(name), folder)
    assert good, note


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) == set(catalog.QUERIES)


def test_entry_has_rows(spark, folder):
    assert entry(spark).count() == 3
