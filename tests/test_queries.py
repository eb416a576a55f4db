"""Every query of the catalogue against its SQL; those without SQL have to run and keep a stable schema."""

import os

import pytest

from siltstone.plans import catalog
from tests.compare import DATA, connect, rows_of, rows_of_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    cols, rows = rows_of(catalog.QUERIES[name](spark, DATA))
    want_cols, want = rows_of_sql(connect(), catalog.SQL[name])
    assert cols == want_cols
    assert rows == want


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
