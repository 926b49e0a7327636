"""Row frames in blocks equal row frames over the whole series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from augurlog.operators import alerts, sequences, series, targets, trends
from augurlog.operators.series import over_rows

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def windows(spark):
    """Series with dense days, days of one row, gaps of days and of months, and one row only."""
    rng = random.Random(7)
    rows = []
    for name, gaps in {"dense": [60] * 3000, "sparse": [90_000] * 40, "mixed": [rng.choice([60, 3600, 86_400, 9_000_000]) for _ in range(300)], "one": [60]}.items():
        t = T0
        for g in gaps:
            t += timedelta(seconds=g)
            rows.append((name, t, rng.randint(0, 1), rng.randint(0, 9), rng.random(), rng.randint(0, 1)))
    rows.append(("mixed", None, 1, 1, 0.5, 0))
    schema = "source_file string, bucket timestamp_ntz, flag int, kw_error long, proba double, y_true int"
    return spark.createDataFrame(rows, schema).repartition(4)


def whole():
    return Window.partitionBy("source_file").orderBy("bucket")


def same(got, want, columns):
    key = lambda df: sorted((tuple(r) for r in df.select("source_file", "bucket", *columns).collect()), key=lambda r: (r[0], r[1] is not None, r[1] or T0))
    a, b = key(got), key(want)
    assert len(a) == len(b) and a == b


@pytest.mark.parametrize("before, after, runs", [(0, 0, (7,)), (1, 0, (1,)), (5, 0, (7,)), (0, 1, ()), (0, 7, (1,)), (3, 4, (1, 64)), (100, 0, (7,)), (0, 200, (1, 7, 64))])
def test_frames(windows, monkeypatch, before, after, runs):
    monkeypatch.setattr(series, "RUNS", runs)
    compute = lambda w: {"s": F.sum("kw_error").over(w.rowsBetween(-before, after)), "n": F.count("*").over(w.rowsBetween(-before, after))}
    same(over_rows(windows, compute, before, after), windows.withColumns(compute(whole())), ["flag", "s", "n"])


def test_lags(windows):
    compute = lambda w: {"lag2": F.lag("proba", 2).over(w), "lead3": F.lead("proba", 3).over(w)}
    same(over_rows(windows, compute, 2, 3), windows.withColumns(compute(whole())), ["lag2", "lead3"])


def test_trends(windows):
    x = F.col("kw_error").cast("double")
    want = windows.withColumns({
        "kw_error_roll3_mean": F.avg(x).over(whole().rowsBetween(-2, 0)), "kw_error_roll6_sum": F.sum(x).over(whole().rowsBetween(-5, 0)),
        "kw_error_diff1": F.coalesce(x - F.lag(x).over(whole()), F.lit(0.0)),
    })
    same(trends.add_trends(windows), want, [f"kw_error{s}" for s in trends.SUFFIXES])


@pytest.mark.parametrize("k", [1, 2, 4, 60])
def test_confirmation(windows, k):
    want = windows.withColumn("c", (F.sum("flag").over(whole().rowsBetween(-(k - 1), 0)) >= k).cast("int"))
    same(alerts.k_confirm(windows, k, "flag", "c"), want, ["c"])


def test_edges_rows_and_sequences(windows):
    rise = F.coalesce((F.col("flag") == 1) & (F.lag("flag").over(whole()) == 0), F.lit(False)).cast("int")
    same(alerts.rising_edges(windows, "flag"), windows.withColumn("rise", rise), ["rise"])
    ahead = F.coalesce(F.max("flag").over(whole().rowsBetween(1, 9)), F.lit(0))
    same(targets.future_labels_rows(windows.withColumnRenamed("flag", "window_is_anomaly"), 9, 60), windows.withColumn("y_future", ahead), ["y_future"])
    listed = windows.withColumn("sequence", F.collect_list("kw_error").over(whole().rowsBetween(-6, -1))).where("size(sequence) = 6")
    same(sequences.sequences(windows, "kw_error", 6, "y_true"), listed, ["sequence"])


@pytest.mark.parametrize("k", [1, 3])
def test_calibration(windows, k):
    """Counts of every threshold against confirmation at that threshold."""
    scores = windows.where("bucket is not null")
    grid = [0.05, 0.2, 0.5, 0.8]
    got = {r.threshold: r for r in alerts.calibration_table(scores, k, grid=grid).collect()}
    for t in grid:
        c = alerts.k_confirm(scores.withColumn("raw", (F.col("proba") >= t).cast("int")), k, "raw")
        want = alerts.alerts_per_day(c).first().alerts_per_day
        n = c.agg(F.count_if(F.expr("predict_confirmed = 1 and y_true = 1")).alias("tp"), F.count_if(F.expr("predict_confirmed = 1 and y_true = 0")).alias("fp")).first()
        assert got[t].alerts_per_day == pytest.approx(want) and (got[t].tp, got[t].fp) == (n.tp, n.fp)


def test_no_window_over_a_whole_series(windows, monkeypatch):
    """The largest group that one task sorts is a run or the edges of runs, not the series."""
    monkeypatch.setattr(series, "RUNS", (1,))
    counted = over_rows(windows.where("source_file = 'dense'"), lambda w: {"n": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}, 2)
    assert counted.agg(F.max("n")).first()[0] <= 1440
