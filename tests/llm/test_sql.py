"""The queries that SQL can express, on the whole of the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tracelane.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in got.description)
    want = sorted(tuple(map(str, (dict(zip([c[0] for c in got.description], r))[c] for c in columns))) for r in got.fetchall())
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want
