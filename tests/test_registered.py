"""Registered queries against their checking SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, normal, same
from workload import catalog

SF = "/root/testdata/sf0.001"
NAMES = (
    "parse_all s6_roundtrip f_combined a6_timeline a9_top_blocked a11_top_clients a13_threat_intel "
    "a15_period_summary a16_geo_events j4_backfill j4a_capped j5_geo_range j10_resolve j12_related "
    "h5_dst_ports h10_signatures h14_report t6_pending m1_retention m2_status p2_router p13_rejects "
    "s1_lines a18_overlay o6_intel_sort j3_two_sided j4_written m1_after_stream"
).split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    want = con.sql(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["ip", "count", "lastSeen", "country", "abuseScore", "hostname"]
    assert rows.count() > 0
