"""Every registered query equals its checking statement."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    ok, message, _ = compare(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["cluster_id", "application_id"]


def test_checks_name_existing_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
