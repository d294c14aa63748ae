"""Every registered query against its independent SQL."""

import pytest
from check import compare, connect, load_entry

from ledgerlake.plans import registry

SF_DIR = "/root/testdata/sf0.001"
ENTRY = load_entry()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    error, _ = compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name])
    assert error is None, error


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(ENTRY.queries()) and set(ORACLE) <= set(ENTRY.oracle_sql())


def test_entry_gives_rows(spark):
    assert ENTRY.entry(spark).count() > 0
