"""The queries of this package against their SQL on the smallest tables."""

import pathlib

import pytest

duckdb = pytest.importorskip("duckdb")

from augurlog.llm import oracle, queries
from check import TABLES, normal

SF = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle.oracle()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = normal(queries.registry()[name](spark, str(SF)).toPandas()), normal(con.sql(oracle.oracle()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.registry()) == list(range(1, 14))
