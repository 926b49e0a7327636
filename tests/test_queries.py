"""Every registered query against its SQL on the smallest tables."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_point
from check import TABLES, normal

SF = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
# Model fits take minutes in all; they run in tools/check.py.
SLOW = {"train_and_score", "explain_model", "svd_embedding"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry_point.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, con, name):
    got = normal(entry_point.queries()[name](spark, str(SF)).toPandas())
    want = normal(con.sql(entry_point.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want), got.compare(want).head().to_string()


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0
