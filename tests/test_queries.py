"""Every registered query against its oracle SQL on the smallest data set."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    same, n, m, diff = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert same, f"{n} rows against {m}: {diff}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_oracle_keys_are_queries():
    assert set(ORACLES) <= set(QUERIES)
