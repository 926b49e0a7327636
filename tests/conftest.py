import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from augurlog.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def make_lines(spark):
    """Lines from (source_file, line_no, 'HH:MM:SS', process, message) tuples."""

    def make(rows):
        full = [(s, n, f"2024-03-01 {t}", p, m) for s, n, t, p, m in rows]
        df = spark.createDataFrame(full, "source_file string, line_no long, t string, process string, message string")
        return df.selectExpr("source_file", "line_no", "CAST(t AS TIMESTAMP_NTZ) AS ts", "process", "message")

    return make
