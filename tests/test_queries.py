"""Every query of the reference's own operators that has SQL, against DuckDB, on the smallest tables."""

import pytest

from lectern.plans import catalogue

from .compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert difference(catalogue.queries()[name](spark, SF), db, catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
