"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()

# Slow streaming queries are covered by test_streams.
NAMES = [n for n in QUERIES if not n.startswith("r")]


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, folder, name):
    ok, message, _, _ = compare(spark, con, folder, name, QUERIES[name], ORACLE.get(name))
    # A few selective queries have no row on the smallest tables; equal and empty is fine there.
    assert ok or message == "rows=0 EMPTY", message


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 1


def test_oracle_names():
    assert set(ORACLE) <= set(QUERIES)
