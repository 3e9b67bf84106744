"""A spread of registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from casetrail.plans import catalog
from tools.compare import TABLES, rows

DATA = "/root/testdata/sf0.001"
PICKED = [
    "build_instances", "journey_overview", "kpi_summary", "context_coverage", "edge_metrics", "probe_membership",
    "dedup_events", "expand_split_rows", "signature_report", "stream_intake", "routing_event", "repeated_runs",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")
@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall())
