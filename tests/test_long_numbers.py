"""Process features in long form, selection of frequent terms, and files per folder."""

import glob
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from augurlog.operators import explain, model as models, ordered, tfidf, trends, windows
from augurlog.operators.windows import KEYS
from augurlog.plans import pipeline
from augurlog.sources import bundle, tables

T0 = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def lines(spark):
    """Three files, some with gaps, each with its own processes and a blank one."""
    rng = random.Random(11)
    rows = []
    for f, gap in (("a", 60), ("b", 2_000), ("c", 40_000)):
        t = T0
        for i in range(700 if f == "a" else 160):
            t += timedelta(seconds=rng.randint(1, gap))
            process = rng.choice(["", "kernel", "sshd", f"p{rng.randint(0, 30)}", f"{f}-own {rng.randint(0, 3)}"])
            rows.append((f, i + 1, t, process, rng.choice(["all fine", "error in disk", "fan speed 3", "timed out", "failed again"])))
    return spark.createDataFrame(rows, "source_file string, line_no long, ts timestamp_ntz, process string, message string")


@pytest.mark.parametrize("use_trends", [False, True])
def test_long_form_equals_wide_form(lines, use_trends):
    cut = windows.create_windows(lines, "10min")
    names = sorted(r.process for r in windows.process_vocabulary(cut).collect())
    wide = windows.widen_processes(cut, names)
    wide = trends.add_trends(wide) if use_trends else wide
    columns = [c for c in wide.columns if c.startswith("cnt_proc_")]
    want = {(r.source_file, r.bucket, c): r[c] for r in wide.collect() for c in columns if r[c]}
    got = {(r.source_file, r.bucket, r.feature): r.x for r in trends.process_features(cut, use_trends).collect()}
    assert got.keys() == want.keys() and len(got) > 300
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)
    # some values stand where the process has no line
    held = {(r.source_file, r.bucket): set(r.proc_counts) for r in cut.collect()}
    absent = [k for k in got if use_trends and k[2].endswith("_diff1") and k[2][9:-6] not in held[k[:2]]]
    assert bool(absent) == use_trends and all(got[k] < 0 for k in absent)


def test_fit_score_and_explanation_equal_wide_form(spark, lines, tmp_path):
    cut = windows.create_windows(lines, "10min").withColumn("y_future", (F.col("kw_error") > 1).cast("int"))
    names = sorted(r.process for r in windows.process_vocabulary(cut).collect())
    counts = tfidf.line_term_counts(lines, "10min")
    wide = trends.add_trends(windows.widen_processes(cut, names))
    train = wide.where("source_file <> 'c'")
    one = models.fit(train, counts, [c for c in trends.numeric_features(wide) if c != "y_future"], max_features=20)
    numbers = trends.process_features(cut)
    thin = trends.add_trends(cut)
    two = models.fit(thin.where("source_file <> 'c'"), counts, [c for c in trends.numeric_features(thin) if c != "y_future"], max_features=20, numbers=numbers)
    assert {f: (pytest.approx(s), pytest.approx(c, abs=2e-3)) for f, s, c in two.all_numeric() if c} == {f: (s, c) for f, s, c in one.numeric if c}
    a = {(r.source_file, r.bucket): r.proba for r in models.score(one, wide, counts).collect()}
    bundle.save_model(two, f"{tmp_path}/m")
    back = bundle.load_model(spark, f"{tmp_path}/m")
    b = {(r.source_file, r.bucket): r.proba for r in models.score(back, thin, counts, numbers=numbers).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 2e-3
    with pytest.raises(ValueError, match="long form"):
        models.score(back, thin, counts)
    # contributions and constants of absent features add up to the log-odds
    features = explain.long_features(back, thin, counts, numbers)
    coefs = explain.coefficient_table(back)
    means = explain.background_means(features, F.lit(thin.count()))
    total = explain.contributions(features, coefs, means).groupBy(*KEYS).agg(F.sum("phi").alias("phi"), F.collect_set("feature").alias("held"))
    absent = {r.feature: r.phi for r in explain.absent_constants(coefs, means).collect()}
    base = back.intercept - sum(absent.values())
    for r in total.collect():
        z = base + r.phi + sum(v for f, v in absent.items() if f not in set(r.held))
        assert models.sigmoid(F.lit(z)) is not None and 1 / (1 + 2.718281828459045 ** -z) == pytest.approx(b[r.source_file, r.bucket], abs=1e-9)
    names = [r.feature for r in explain.feature_names(back).orderBy("idx").collect()]
    assert len(names) == len(set(names)) == back.meta["terms"] + len(back.features)


def test_twenty_thousand_processes(spark):
    """Two thousand files with ten process names each, through preparation, fit and scores."""
    n = spark.range(24_000).withColumn("file", F.col("id") % 2000).withColumn("i", F.floor(F.col("id") / 2000))
    lines = n.select(
        F.concat(F.lit("host"), F.col("file")).alias("source_file"), (F.col("i") + 1).alias("line_no"),
        (F.lit("2024-03-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(i * 7 as int), 0)")).alias("ts"),
        F.concat(F.lit("proc"), F.col("file"), F.lit("-"), F.col("i") % 10).alias("process"),
        F.when(F.xxhash64("id") % 5 == 0, "segfault in disk").otherwise("all fine").alias("message"),
    )
    settings = pipeline.with_settings(width="5min", horizon_min=15, min_lines=0, max_features=10, k_confirm=2)
    prepared = pipeline.prepare(lines, "linux", settings)
    assert prepared.processes.count() == 20_000
    trained = pipeline.train(prepared, pipeline.with_settings(settings, policy="pr_max"))
    assert trained.model.numbers.count() == 80_000
    out = pipeline.score(prepared, trained.model, trained.threshold, settings)
    assert out.count() == prepared.windows.count() == 24_000
    assert out.where("early_warning_score IS NULL").isEmpty()
    # the same processes for other lines
    again = pipeline.prepare(lines.where("source_file < 'host11'"), "linux", settings, trained.model.processes)
    assert again.numbers.join(trained.model.numbers, "feature", "left_anti").isEmpty()


def test_largest(spark):
    rng = random.Random(2)
    rows = [(f"t{i:04d}", rng.choice([1, 1, 1, 2, 5, 9, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "term string, cf int")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for n in (0, 1, 3, 200, 500, 1000, 1400, 1499, 1500, 2000):
        assert sorted(r.term for r in ordered.largest(df, n, "cf", "term").collect()) == sorted(t for t, _ in order[:n]), n


def test_files_follow_size(spark, tmp_path):
    """Rows of one large and many small folders come from every task."""
    df = spark.range(0, 40_000, 1, 16).select(
        F.when(F.col("id") % 4 < 3, "large").when(F.col("id") % 400 == 399, None).otherwise(F.concat(F.lit("s"), F.col("id") % 10)).alias("source_file"), "id"
    )
    assert tables.write_table(df, f"{tmp_path}/t", partition_by=("source_file",), chunk_rows=6000) == 40_000
    files = {d.rsplit("=", 1)[1]: len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{tmp_path}/t/source_file=*")}
    assert files.pop("large") == 5 and set(files.values()) == {1} and len(files) == 6
    assert spark.read.parquet(f"{tmp_path}/t").select("id").distinct().count() == 40_000
    assert tables.write_table(df.limit(0), f"{tmp_path}/none", partition_by=("source_file",)) == 0
