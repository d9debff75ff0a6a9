"""Every registered query against DuckDB on whole tables."""

import pytest

import oracle
from tidegauge.bindings import load

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()
FITTED = {n for n in QUERIES if n not in SQL}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows_as_sql(spark, con, name):
    verdict, _ = oracle.compare(spark, con, SF, QUERIES[name], SQL[name])
    assert verdict == "ok"


@pytest.mark.parametrize("name", sorted(FITTED))
def test_fitted_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
