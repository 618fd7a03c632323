"""Queries with SQL give DuckDB's rows; the entry module works with and without the subpackage."""

import duckdb
import pytest

import __spark_entry__ as entry
from vantage import queries

NAMES = sorted(queries.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("events", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, duck, name):
    got, want = queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(got.select(cols).collect()) == key(want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", ["daily_brief", "graph_nodes", "unusual_top1", "anomaly_scores", "explain", "graph_edges"])
def test_driver_plans_written_tables(spark, sf, name):
    """The driver holds one short plan over written tables, not that of all steps since the events."""
    plan = queries.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "event_id" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
