"""Queries against their SQL, on the smallest tables; and what the driver asks of the entry."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracelane.plans.demo import demo_tables
from tracelane.plans.queries import table_counts
from tracelane.sources.store import Store

DATA = "/root/testdata/sf0.001"
SOME = ["object", "leg_summary", "relay_series", "trust", "coverage", "object_bitrate_summary", "distribution_bin", "shape_drift", "recovered_dwell", "relay_only_distribution", "event", "track"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("" if r[i] is None else f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.columns, df.collect()) == plain(columns, got.fetchall())


def test_sums_beyond_long(spark):
    """Times that add up to more than a long holds are counted exactly; those within stay longs."""
    t = demo_tables(spark, DATA)
    few = table_counts(t, Store(spark))
    assert dict(few.dtypes)["times"] == dict(few.dtypes)["sizes"] == "bigint"
    far = 1 << 61
    much = table_counts(t.with_(subgroup_object=t.subgroup_object.withColumn("time_us", F.col("time_us") + far)), Store(spark))
    want = {(r.part, r.trace_id): (r.n, r.times + far * r.n * (r.part == "subgroup_object"), r.sizes) for r in few.collect()}
    assert max(v[1] for v in want.values()) >= 1 << 63
    assert {(r.part, r.trace_id): (r.n, int(r.times), int(r.sizes)) for r in much.collect()} == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
