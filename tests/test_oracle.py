"""Every catalogue query against its independent DuckDB SQL at sf 0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry_mod
from tests.compare import compare, duck
from tests.conftest import SF01

from cotopic.plans import catalogue

QUERIES = {k: f for k, f in entry_mod.queries().items() if k in catalogue.QUERIES}
ORACLE = {k: s for k, s in entry_mod.oracle_sql().items() if k in catalogue.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    problems, n_spark, n_duck = compare(df, con, ORACLE[name])
    assert not problems, problems
    assert n_spark == n_duck
