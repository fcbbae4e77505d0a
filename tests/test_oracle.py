"""Every query with a SQL form, compared at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as S
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = S.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(S.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    problem = compare(con, spark, SF, S.queries()[name], SQL[name])
    assert problem is None or (problem == "no rows" and name in {"error_rare_items"})


@pytest.mark.parametrize("name", sorted(set(S.queries()) - set(SQL)))
def test_rows_only(spark, name):
    assert S.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert S.entry(spark).count() == 2535
