import random
from datetime import datetime, timedelta

import pytest

from augurlog.operators import alerts, evaluate, ordered, targets

T0 = datetime(2024, 1, 1)


@pytest.fixture
def table(spark):
    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return df.withColumn("bucket", df.bucket.cast("timestamp_ntz"))

    return make


def random_flags(seed, n=600, series=3, step=5):
    rng = random.Random(seed)
    out = []
    for s in range(series):
        t = T0
        for _ in range(n // series):
            t += timedelta(minutes=step * rng.randint(1, 4))
            out.append((f"f{s}", t, int(rng.random() < 0.08)))
    return out


@pytest.mark.parametrize("horizon", [0, 15, 60, 3000])
def test_future_labels_by_brute_force(table, horizon):
    rows = random_flags(horizon)
    df = table(rows, "source_file string, bucket timestamp, window_is_anomaly int")
    got = {(r.source_file, r.bucket): r.y_future for r in targets.future_labels(df, horizon).collect()}
    hits = [(s, t) for s, t, a in rows if a]
    for s, t, _ in rows:
        want = any(s == s2 and t < t2 <= t + timedelta(minutes=horizon) for s2, t2 in hits)
        assert got[(s, t)] == int(want)
    assert len(got) == len(rows)


def test_future_label_edges(table):
    rows = [("f", T0, 1), ("f", T0 + timedelta(minutes=15), 1), ("f", T0 + timedelta(minutes=31), 0)]
    df = table(rows, "source_file string, bucket timestamp, window_is_anomaly int")
    got = [r.y_future for r in targets.future_labels(df, 15).orderBy("bucket").collect()]
    assert got == [1, 0, 0]  # at t itself: 0; at t + horizon: 1; last row: 0
    rows_form = [r.y_future for r in targets.future_labels_rows(df, 1, 60).orderBy("bucket").collect()]
    assert rows_form == [1, 0, 0]


def test_k_confirm_and_edges(table):
    flags = [1, 1, 1, 0, 1, 1, 1, 1]
    rows = [("f", T0 + timedelta(hours=6 * i), v) for i, v in enumerate(flags)]
    df = table(rows, "source_file string, bucket timestamp, predict_raw int")
    out = alerts.rising_edges(alerts.k_confirm(df, 3)).orderBy("bucket").collect()
    assert [r.predict_confirmed for r in out] == [0, 0, 1, 0, 0, 0, 1, 1]
    assert [r.rise for r in out] == [0, 0, 1, 0, 0, 0, 1, 0]
    assert [r.predict_confirmed for r in alerts.k_confirm(df, 1).orderBy("bucket").collect()] == flags
    # k = 1: the first row is positive but not an edge
    first = alerts.rising_edges(alerts.k_confirm(df, 1)).orderBy("bucket").first()
    assert first.rise == 0
    assert alerts.alerts_per_day(alerts.k_confirm(df, 3)).first()[0] == 1.0


def test_confirmation_does_not_cross_series(table):
    rows = [("a", T0, 1), ("a", T0 + timedelta(hours=1), 1), ("b", T0 + timedelta(hours=2), 1)]
    df = table(rows, "source_file string, bucket timestamp, predict_raw int")
    assert sum(r.predict_confirmed for r in alerts.k_confirm(df, 3).collect()) == 0


def brute_calibration(rows, k, grid):
    out = {}
    series = sorted({r[0] for r in rows})
    days = {r[1].date() for r in rows}
    for t in grid:
        rises = tp = fp = fn = 0
        for s in series:
            mine = sorted(r for r in rows if r[0] == s)
            raw = [int(r[2] >= t) for r in mine]
            conf = [int(i + 1 >= k and all(raw[i - k + 1 : i + 1])) for i in range(len(raw))]
            rises += sum(conf[i] == 1 and conf[i - 1] == 0 for i in range(1, len(conf)))
            for c, r in zip(conf, mine):
                tp += c == 1 and r[3] == 1
                fp += c == 1 and r[3] == 0
                fn += c == 0 and r[3] == 1
        out[t] = (rises / len(days), tp, fp, fn)
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_calibration_by_brute_force(table, k):
    rng = random.Random(k)
    rows = [(s, t, round(rng.random(), 2), int(rng.random() < 0.3)) for s, t, _ in random_flags(k, 300)]
    df = table(rows, "source_file string, bucket timestamp, proba double, y_true int")
    grid = alerts.threshold_grid(df)
    got = {r.threshold: (r.alerts_per_day, r.tp, r.fp, r.fn) for r in alerts.calibration_table(df, k).collect()}
    want = brute_calibration(rows, k, grid)
    assert set(got) == set(want)
    for t in want:
        assert got[t] == pytest.approx(want[t])
    best = alerts.calibrate_alert_budget(df, 2.0, k).first()
    order = sorted(want, key=lambda t: (abs(want[t][0] - 2.0), -t))
    assert best.threshold == order[0]


def test_quantiles_and_running_totals(spark):
    import numpy as np

    rng = random.Random(3)
    values = [round(rng.gauss(0, 1), 2) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    levels = [0.0, 0.1, 0.5, 0.777, 0.999, 1.0]
    got = {r.level: r["quantile"] for r in ordered.exact_quantiles(df, "v", levels).collect()}
    for q in levels:
        assert got[q] == pytest.approx(float(np.quantile(values, q)), abs=1e-12)
    counted = df.groupBy("v").count()
    for descending in (False, True):
        out = ordered.running_totals(counted, "v", {"upto": "count"}, descending).collect()
        seen = {r.v: r.upto for r in out}
        for v in (min(values), max(values), 0.0):
            want = sum(x >= v if descending else x <= v for x in values)
            assert seen[v] == want


# Published validation scores of a servicing-log run: (score, truth).
GOLDEN = [
    (0.0607397038650595, 0), (0.18996942238311415, 0), (0.007632810233465826, 0), (0.8938092982775137, 1),
    (0.04715089558922276, 0), (0.04328249990935876, 0), (0.16960573591374853, 0), (0.01275222744640948, 0),
    (0.9599449079155555, 0), (0.02394583054077926, 0), (0.30443991971463924, 1), (0.004516147105696028, 0),
    (0.47295896798492665, 0),
]


def test_golden_scores(spark):
    df = spark.createDataFrame(GOLDEN, "proba double, y_true int")
    assert evaluate.average_precision(df).first()[0] == pytest.approx(0.5)
    chosen = evaluate.choose_threshold(df, "precision", 0.8).first()
    assert chosen.threshold == 0.30443991971463924 and not chosen.met_target
    judged = df.withColumn("y_pred", alerts.raw_decision(df.proba, chosen.threshold))
    cells = {(r.actual, r.predicted): r.n for r in evaluate.confusion_matrix(judged).collect()}
    assert cells == {(0, 0): 9, (0, 1): 2, (1, 0): 0, (1, 1): 2}
    report = {r.label: r for r in evaluate.classification_report(judged).collect()}
    assert round(report["0"].recall, 4) == 0.8182 and round(report["0"].f1, 4) == 0.9
    assert (round(report["1"].precision, 4), report["1"].recall, round(report["1"].f1, 4)) == (0.5, 1.0, 0.6667)
    assert round(report["accuracy"].f1, 4) == 0.8462
    assert round(report["macro avg"].recall, 4) == 0.9091 and round(report["weighted avg"].f1, 4) == 0.8641
    assert evaluate.choose_threshold(df, "min_score").first().threshold == 0.004516147105696028
    assert evaluate.choose_threshold(df, "pr_max").first().threshold == 0.30443991971463924
    # a reachable target: the lowest score that keeps the precision
    assert evaluate.choose_threshold(df, "precision", 0.5).first().threshold == 0.30443991971463924


# Published scores of all 63 windows of that run, in time order.
GOLDEN_ALL = [
    0.254348, 0.080016, 0.004464, 0.544193, 0.006643, 0.959435, 0.004154, 0.175595, 0.201291, 0.043029, 0.101008,
    0.015066, 0.943267, 0.069824, 0.052511, 0.236619, 0.006718, 0.376132, 0.291155, 0.010836, 0.909928, 0.013390,
    0.072654, 0.021166, 0.044994, 0.054338, 0.373500, 0.008017, 0.321296, 0.167816, 0.048086, 0.031332, 0.873650,
    0.039628, 0.514572, 0.008390, 0.667879, 0.008513, 0.271066, 0.075986, 0.776807, 0.056926, 0.316738, 0.005429,
    0.141932, 0.281879, 0.034408, 0.085794, 0.454050, 0.015138, 0.060740, 0.189969, 0.007633, 0.893809, 0.047151,
    0.043282, 0.169606, 0.012752, 0.959945, 0.023946, 0.304440, 0.004516, 0.472959,
]


def test_golden_confirmation(table):
    rows = [("w", T0 + timedelta(minutes=i), p) for i, p in enumerate(GOLDEN_ALL)]
    df = table(rows, "source_file string, bucket timestamp, p double")
    raw = df.withColumn("predict_raw", alerts.raw_decision(df.p, 0.30443991971463924))
    summary = alerts.prediction_summary(alerts.k_confirm(raw, 3)).first()
    assert (summary.windows, summary.raw_positive, summary.confirmed_positive) == (63, 17, 0)


def test_split_guards_and_hygiene(table):
    rows = [(f"f{i % 3}", T0 + timedelta(minutes=i), i % 4 == 0) for i in range(100)]
    df = table([(s, t, int(a)) for s, t, a in rows], "source_file string, bucket timestamp, window_is_anomaly int")
    split = targets.chronological_split(df, 0.2)
    assert split.where("is_train").count() == 80
    last = sorted((s, t) for s, t, _ in rows)[79]
    assert max((r.source_file, r.bucket) for r in split.where("is_train").collect()) == last
    assert targets.train_part(split).where("window_is_anomaly = 1").count() == 0
    assert targets.test_part(split).count() == 20
    with pytest.raises(ValueError, match="leaves too few rows on one side"):
        targets.chronological_split(df.limit(40), 0.2)
