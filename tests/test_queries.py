"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from folioscope.plans.queries import QUERIES
from oracle.statements import STATEMENTS
from tools.check_queries import TABLES, rows

FOLDER = Path(entry_points.SMOKE_DIR)
SLOW = {"grid_search", "train_linear_classifier"}  # many fits on little data
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not there")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_every_statement_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) == set(STATEMENTS)


def test_entry(spark):
    report = entry_points.entry(spark).collect()
    assert len(report) == 1 and report[0].transaction_count > 0


@pytest.mark.parametrize("name", sorted(set(STATEMENTS) - SLOW))
def test_query_matches_sql(spark, db, name):
    got = entry_points.queries()[name](spark, str(FOLDER)).toPandas()
    want = db.sql(entry_points.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
