"""The registered queries at the smallest test size: the results' columns, no duplicate rows, and SQL where there is some."""

import os

import pytest

from siltstone.llm import queries as Q
from tests.compare import DATA, connect, rows_of, rows_of_sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

FOUND = {
    "p1_found": [("sample_index", "bigint"), ("defect", "string")],
    "p3_found": [("sample_index", "bigint"), ("turn_no", "int"), ("message_id", "bigint")],
    "p4_found": [("origin", "string"), ("row_key", "bigint"), ("item_id", "bigint")],
    "p7_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_columns(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    assert df.dtypes == FOUND[name]
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, name):
    assert rows_of(Q.QUERIES[name](spark, DATA)) == rows_of_sql(connect(), Q.SQL[name])


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.SQL.keys() - FOUND.keys()))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0
