"""Every query with SQL gives the same rows as that SQL on another engine."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from panelforge.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def plain(row) -> tuple:
    return tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.date() if isinstance(v, dt.datetime) else v for v in row)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, engine, name):
    df = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = engine.sql(f"SELECT {quoted} FROM ({catalogue.oracle_sql()[name]}) AS q").fetchall()
    got = [plain(r) for r in df.select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(str(plain(r)) for r in want)


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_scans_are_pruned(spark):
    plan = catalogue.monthly_total_turnover(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "c_comment" not in plan and "o_orderpriority" not in plan
