"""The live queries give what the batch operators give, over restarts and late lines."""

import math

import pytest

from augurlog.functions.dialects import LINUX
from augurlog.operators import alerts, model as models, tfidf, trends, windows
from augurlog.sources.parse import parse_lines, parse_timestamps
from augurlog.streaming import live

NUMERIC = [("kw_error", 1.0, 0.7), ("kw_error_roll6_sum", 2.0, 0.3), ("cnt_proc_p1_diff1", 1.0, -0.2), ("lines", 5.0, 0.4)]


def log_lines(hours, offset=0):
    texts = ["disk error", "link up", "ok, fine", "session opened"]
    out = []
    for h in hours:
        for i in range(0, 60, 4):
            k = h * 15 + i + offset
            out.append(f"Mar  3 {h:02d}:{i:02d}:{k % 60:02d} node{k % 2} p{k % 3}[{k}]: {texts[k % 4]} {h}")
    return out


@pytest.fixture(scope="module")
def model(spark):
    terms = spark.createDataFrame(
        [("error", 1.5, 0, 0.8), ("link up", 2.0, 1, -0.5), ("p1", 1.0, 2, 0.2)], "term string, idf double, idx int, coef double"
    )
    return models.Model(terms, NUMERIC, -1.0, meta={"terms": 3})


def run(spark, root, model):
    return live.run_available(
        spark, f"{root}/landing", root, model, 0.5, width="10min", year=2024, k=2, min_lines=2, lateness="20 minutes"
    )


def test_live_equals_batch_over_a_restart(spark, tmp_path, model):
    root = str(tmp_path)
    landing = tmp_path / "landing"
    landing.mkdir()
    first, second = log_lines(range(0, 4)), log_lines(range(4, 8))
    (landing / "a.log").write_text("\n".join(first + ["free text line"]) + "\n")
    run(spark, root, model)
    late = "Mar  3 00:05:00 node0 p0[1]: late line"
    (landing / "b.log").write_text("\n".join(second + [late]) + "\n")
    closing = run(spark, root, model)
    assert live.dropped_late_rows(closing) == 1
    late = live.late_lines(spark, f"{root}/events", f"{root}/windows", "10min").where("late > 0").collect()
    assert [(r.source_file, r.late) for r in late] == [("node0", 1)]

    got = spark.read.parquet(f"{root}/alerts")
    keys = [(r.source_file, str(r.bucket)) for r in got.collect()]
    assert len(keys) == len(set(keys))

    raw = [("x", i, t) for i, t in enumerate(first + second)]
    df = parse_lines(spark.createDataFrame(raw, "f string, line_no long, raw string"), LINUX)
    lines = parse_timestamps(df, LINUX, 2024, series="f").withColumn("source_file", df.host)
    cut = windows.widen_processes(windows.create_windows(lines, "10min", LINUX, ["p1"]), ["p1"])
    closed = trends.add_trends(cut).where("bucket + INTERVAL 10 MINUTES <= TIMESTAMP_NTZ '2024-03-03 07:36:00'")
    counts = tfidf.line_term_counts(lines, "10min")
    scored = models.score(model, closed, counts).where("lines >= 2")
    want = alerts.k_confirm(scored.withColumn("predict_raw", alerts.raw_decision(scored.proba, 0.5)), 2)
    expected = {
        (r.source_file, str(r.bucket)): (r.proba, r.predict_raw, r.predict_confirmed, r.lines) for r in want.collect()
    }
    actual = {
        (r.source_file, str(r.bucket)): (r.early_warning_score, r.predict_raw, r.predict_confirmed, r.lines)
        for r in got.collect()
    }
    assert set(actual) == set(expected)
    for k in expected:
        assert actual[k][0] == pytest.approx(expected[k][0], abs=1e-9)
        assert actual[k][1:] == expected[k][1:]
    assert {v[2] for v in actual.values()} == {0, 1}
    assert live.confirmed_alerts(got).where("alert_line NOT LIKE 'EARLY WARNING%'").count() == 0

    events = spark.read.parquet(f"{root}/events")
    assert events.count() == len(first + second) + 2
    fallback = events.where("NOT parsed").first()
    assert fallback.message == "free text line" and fallback.ts is not None and fallback.host == ""


def test_state_step_restarts_from_its_state():
    rule = live.AlertRule([("a_roll6_sum", 1.0, 1.0)], 0.0, 0.9, 2, 0, ["a"])

    class State:
        def __init__(self):
            self.value = None

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value
    import pandas as pd

    rows = [{"source_file": "s", "bucket": i, "lines": 1, "a": i, "text_logit": 0.0, "example_text": ""} for i in range(9)]
    whole = pd.concat(live.alert_state(rule)(("s",), iter([pd.DataFrame(rows)]), State()))
    state, parts = State(), []
    for piece in (rows[:4], rows[4:5], rows[2:5], rows[4:]):  # windows given again are passed over
        parts += list(live.alert_state(rule)(("s",), iter([pd.DataFrame(piece)]), state))
    pieces = pd.concat(parts)
    assert pieces.early_warning_score.tolist() == whole.early_warning_score.tolist()
    assert pieces.predict_confirmed.tolist() == whole.predict_confirmed.tolist()
    assert whole.early_warning_score.tolist()[-1] == pytest.approx(1 / (1 + math.exp(-sum(range(3, 9)))))


def test_csv_collector(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.log").write_text("Mar  3 01:02:03 h p[4]: a, b\nnope, no\n")
    live.start_collector(
        spark, str(landing), str(tmp_path / "out"), str(tmp_path / "cp"), year=2024, fmt="csv", trigger=live.AVAILABLE
    ).awaitTermination()
    rows = spark.read.option("header", "true").csv(str(tmp_path / "out")).orderBy("raw").collect()
    assert [r.message for r in rows] == ["a  b", "nope  no"]
    assert rows[0].os == "linux" and rows[0].source == "file" and rows[0].host == "h"


def test_silent_hosts_leave_the_state(spark, tmp_path, model):
    """A host that sends nothing for the time of silence is dropped; one that comes back starts anew."""
    landing, root = tmp_path / "landing", str(tmp_path)
    landing.mkdir()

    def step(name, hosts, day, silence):
        lines = [f"Mar {day:2d} {h:02d}:{m:02d}:00 {host} p1[1]: disk error" for host in hosts for h in range(3) for m in (0, 5, 11, 14, 25)]
        (landing / name).write_text("\n".join(lines) + "\n")
        live.start_collector(spark, str(landing), f"{root}/events", f"{root}/_c", year=2024, trigger=live.AVAILABLE).awaitTermination()
        live.make_folders(spark, f"{root}/windows")
        live.start_windows(spark, f"{root}/events", f"{root}/windows", f"{root}/_w", model, width="10min", lateness="1 minute", trigger=live.AVAILABLE).awaitTermination()
        query = live.start_alerts(spark, f"{root}/windows", f"{root}/alerts", f"{root}/_a", model, 0.5, k=2, min_lines=1, trigger=live.AVAILABLE, silence=silence)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert step("a.log", ["gone", "stays"], 3, "2 days") == 2
    assert step("b.log", ["stays"], 9, "2 days") == 1
    assert step("c.log", ["gone", "stays"], 10, "2 days") == 2
    got = spark.read.parquet(f"{root}/alerts").where("source_file = 'gone'").orderBy("bucket").collect()
    assert [str(r.bucket)[:10] for r in got] == sorted(str(r.bucket)[:10] for r in got) and {str(r.bucket)[8:10] for r in got} == {"03", "10"}
    # confirmation and trends of the first window after the return are those of a first window
    back = next(r for r in got if str(r.bucket).startswith("2024-03-10"))
    assert back.predict_confirmed == 0 and back.early_warning_score == pytest.approx(got[0].early_warning_score)
