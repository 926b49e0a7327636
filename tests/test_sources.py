import pathlib
import random

import pytest

from augurlog.session import materialise, scratch_path
from augurlog.sources import bundle, tables
from augurlog.sources.logfiles import read_logs, read_raw


def test_large_file_is_read_in_splits_with_exact_numbers(spark, tmp_path):
    rng = random.Random(1)
    lines, expected, head = [], [], ("", "")
    for i in range(4000):
        kind = rng.random()
        if kind < 0.1:
            line = ""
        elif kind < 0.4:
            line = "tail " + "y" * rng.randint(0, 60)
        else:
            head = (f"2016-09-{rng.randint(1, 28):02d} 04:30:{rng.randint(0, 59):02d}", rng.choice(["CBS", "CSI"]))
            line = f"{head[0]}, Info                  {head[1]}    message {i}"
        lines.append(line)
        if line:
            expected.append((i + 1, *head, line))
    (tmp_path / "big.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "skip.txt").write_text("not a log\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert read_raw(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        got = read_logs(spark, str(tmp_path), "windows").orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.line_no, r.timestamp, r.process, r.raw) for r in got] == expected
    assert {r.os for r in got} == {"windows"}


def test_folder_recursion_and_single_file(spark, tmp_path):
    sub = tmp_path / "deep"
    sub.mkdir()
    (tmp_path / "a.log").write_text("Mar  1 08:15:00 h p[1]: one\nfree text\n")
    (sub / "b.log").write_text("Mar  2 08:15:00 h p: two\n")
    assert read_logs(spark, str(tmp_path), "linux").count() == 2
    assert read_logs(spark, str(tmp_path), "linux", recursive=True).count() == 3
    rows = read_logs(spark, str(tmp_path / "a.log"), "linux", year=2025).orderBy("line_no").collect()
    assert str(rows[0].ts) == "2025-03-01 08:15:00" and rows[0].pid == "1"
    assert rows[1].ts is None and rows[1].raw == "free text" and rows[1].message == ""


def test_encoding_policies(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"Mar  1 08:15:00 h p: caf\xe9 x\n")
    read = lambda **kw: read_logs(spark, str(tmp_path), "linux", **kw).first().message
    assert read() == "caf� x"
    assert read(errors="ignore") == "caf x"
    assert read(encoding="ISO-8859-1") == "café x"
    with pytest.raises(Exception):
        read(errors="strict")
    with pytest.raises(ValueError):
        read(errors="other")
    with pytest.raises(ValueError):
        read(encoding="utf-16")


def test_byte_order_mark_is_dropped(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbf2016-09-28 04:30:30, Info   CBS    x\n")
    assert read_logs(spark, str(tmp_path), "windows", encoding="utf-8-sig").first().process == "CBS"


def test_stage_tables(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, 'say "hi", now'), ("g", 2, None)], "source_file string, n long, t string")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        assert tables.write_table(df, path, fmt, chunk_rows=1) == 2
        back = tables.read_table(spark, path, df.schema, fmt)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "csv"), fmt="csv")
    tables.write_table(df, str(tmp_path / "parts"), partition_by=("source_file",))
    assert {p.name for p in (tmp_path / "parts").glob("source_file=*")} == {"source_file=f", "source_file=g"}


def test_union_and_merge(spark, tmp_path):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, "z")], "x int, w string")
    both = tables.union_tables([a, b])
    assert both.columns == ["x", "y", "w"]
    assert sorted((r.x, r.y, r.w) for r in both.collect()) == [(1, 2, None), (3, None, "z")]
    with pytest.raises(ValueError):
        tables.union_tables([])
    a.write.parquet(str(tmp_path / "m" / "one"))
    b.write.parquet(str(tmp_path / "m" / "two"))
    merged = tables.merge_files(spark, str(tmp_path / "m"))
    assert set(merged.columns) == {"x", "y", "w", "source_file"} and merged.count() == 2


def test_thresholds_latest_wins(spark, tmp_path):
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        bundle.load_threshold(spark, path)
    bundle.add_threshold(spark, path, 0.4, "precision", target_precision=0.8)
    bundle.add_threshold(spark, path, 0.7, "alert_budget")
    assert bundle.load_threshold(spark, path) == 0.7
    assert bundle.thresholds(spark, path).count() == 2


def test_scratch_follows_the_session(spark):
    path = scratch_path(spark, "x")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or path.startswith(configured)
    kept = materialise(spark.range(3))
    assert kept.count() == 3 and pathlib.Path(kept.inputFiles()[0].replace("file://", "")).exists()


def test_scratch_of_a_cluster_must_be_shared():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session, "x")
