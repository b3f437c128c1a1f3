"""Every registered query of the library runs; those with an SQL twin give its rows."""

import os

import pytest

from tests.compare import connection, differences
from textmill.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    assert differences(spark, SF_DIR, registry.queries()[name], registry.oracle_sql()[name], duck) == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    frame = registry.queries()[name](spark, SF_DIR)
    assert len(set(frame.columns)) == len(frame.columns)
    frame.collect()


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
