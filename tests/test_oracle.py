"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SF_DIR
from oracle_check import differences

import __spark_entry__ as entry
from tierwise import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", list(ORACLE))
def test_matches_sql(spark, con, key):
    assert differences(QUERIES[key](spark, SF_DIR), con, ORACLE[key]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
