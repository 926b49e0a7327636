"""Parsed lines as CSV, input without a usable time, and late lines of the live path."""

import pytest
from pyspark.sql import functions as F

from augurlog.plans import pipeline
from augurlog.sources.logfiles import read_logs, read_parsed

LINES = [
    "Mar  3 10:00:01 h kernel[7]: link up", 'Mar  3 10:00:05 h sshd: said "no, never", left', "-- marker", "Mar  3 10:07:00 h p[1]: Out of memory: kill", "Mar 33 99:00:00 h p: odd date",
]


def test_csv_equals_log(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES) + "\n")
    want = read_logs(spark, f"{tmp_path}/a.log", "linux", 2024)
    columns = ["line_no", "timestamp", "host", "process", "pid", "message", "raw"]
    want.select(columns).coalesce(1).write.option("header", "true").option("escape", '"').csv(f"{tmp_path}/out")
    got = read_parsed(spark, f"{tmp_path}/out", "linux", 2024)
    assert got.columns == want.columns
    order = lambda df: sorted(tuple(r) for r in df.select("os", *columns, F.col("ts").cast("string")).fillna("-").collect())
    assert order(got) == order(want) and got.count() == 5
    # columns a file lacks are empty, a number that is none is null
    (tmp_path / "short.csv").write_text("message,timestamp,line_no\nhello,Mar  3 10:00:01,x\n")
    row = read_parsed(spark, f"{tmp_path}/short.csv", "linux", 2024).first()
    assert (row.message, row.process, row.line_no, str(row.ts)) == ("hello", "", None, "2024-03-03 10:00:01")


def test_pipeline_takes_csv(spark, tmp_path):
    rows = [f"{i},Mar  {3 + i // 400} {i // 20 % 20:02d}:{i % 20 * 3:02d}:00,h,p{i % 3},,{'Out of memory' if i % 90 == 0 else 'all fine'},raw" for i in range(1200)]
    (tmp_path / "lines.csv").write_text("line_no,timestamp,host,process,pid,message,raw\n" + "\n".join(rows) + "\n")
    settings = pipeline.with_settings(pipeline.RUNNER, year=2025, max_features=20, min_lines=0, policy="pr_max")
    run = pipeline.run_pipeline(spark, f"{tmp_path}/lines.csv", "linux", f"{tmp_path}/out", settings)
    assert run.predictions.count() == run.prepared.windows.count() > 400
    certificate = pipeline.fit_certificate(run.prepared, run.trained, settings).first()
    assert certificate.largest_gradient < 1e-4 and certificate.windows == run.trained.train.count()


def test_no_usable_time(spark, tmp_path):
    (tmp_path / "a.log").write_text("no header\nnone here either\n")
    with pytest.raises(ValueError, match="no line has a usable time"):
        pipeline.run_pipeline(spark, f"{tmp_path}/a.log", "linux", f"{tmp_path}/out")
