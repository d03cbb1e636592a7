"""Registered queries against their SQL on the smallest data, and batch against stream."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from crawlsift.plans import catalog, oracles

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")

CHECKED = [
    "inline_scripts", "script_sources", "dom_endpoints", "inline_endpoints", "text_endpoints",
    "network_endpoints", "rule_secrets", "entropy_secrets", "capture_collapse", "capture_count", "capture_orders", "capture_index", "host_secrets",
    "host_endpoints", "host_log_merge", "rescan_triggers", "latest_scan", "host_stats", "merged_secrets", "review_endpoints",
    "export_json", "stream_sessions", "stream_scan", "stream_network", "stream_tabs", "stream_host_log",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and rows(got) == rows(want)


def test_every_query_is_registered():
    names, sqls = set(entry.queries()), set(entry.oracle_sql())
    assert sqls <= names and set(catalog.queries()) <= names
    assert set(catalog.queries()) == set(oracles.oracle_sql())
