"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import duckdb
import pytest

import check
from sunledger.plans.oracle import ORACLE
from sunledger.plans import store_oracle, store_queries  # noqa: F401  they register more
from sunledger.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
# Views of the same rollup or the same filled store; check.py covers them too.
SAME_ROLLUP = {"site_rollup_hourly", "site_ratios", "completeness_stats", "site_report", "continuity", "quality_and",
               "stream_device_events", "stream_availability"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SAME_ROLLUP])
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == check.rows_of(cols, cur.fetchall())
    assert got
