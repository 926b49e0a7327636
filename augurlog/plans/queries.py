"""Registered queries: every operator over whole test tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame; ``oracle.py`` holds the SQL
that must give the same rows.  Buckets are one hour wide because the event tables
are sparse.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurlog.functions.dialects import DIALECTS, dialect as as_dialect
from augurlog.functions.text import example_text
from augurlog.functions.timestamps import width_seconds
from augurlog.operators import alerts, evaluate, explain, labels, model, sequences, svd, targets, tfidf, trends, windows
from augurlog.operators.windows import KEYS
from augurlog.plans import pipeline
from augurlog.session import materialise, scratch_path, spread
from augurlog.sources import bundle, parse, tables
from augurlog.sources.event_lines import event_lines, rendered_lines, rendered_year
from augurlog.sources.logfiles import read_logs
from augurlog.streaming import live

WIDTH = "1h"
WIDTH_SEC = 3600
HORIZON_MIN = 180
MIN_LINES = 3
K = 2
PIVOT = ["cron.d", "kernel", "rsyslogd", "sshd", "systemd"]
THRESHOLD = 0.55
SEQ_LEN = 4


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- shared steps -------------------------------------------------------------

def lines(spark, sf, d="linux"):
    return event_lines(spark, sf, d)


def documents(spark, sf):
    return spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def flagged_lines(spark, sf):
    """Lines with a line-level truth flag (about one in a hundred)."""
    return lines(spark, sf).withColumn("is_anomaly", (F.col("line_no") % 97 == 5).cast("int"))


def flagged_windows(spark, sf):
    cut = windows.create_windows(lines(spark, sf), WIDTH, processes=PIVOT)
    flags = labels.window_anomaly_from_lines(flagged_lines(spark, sf), WIDTH)
    return targets.join_anomaly_flags(cut, flags)


def scores(spark, sf):
    """``source_file, bucket, lines, window_is_anomaly, y_true, proba``.

    The score is a ratio of whole numbers, so both engines agree to the last bit.
    """
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    agg = windows.bucketed(flagged_lines(spark, sf), WIDTH).groupBy(*KEYS).agg(
        F.count("*").alias("lines"),
        F.max("is_anomaly").alias("window_is_anomaly"),
        cents.alias("cents"),
    )
    future = targets.future_labels(agg, HORIZON_MIN)
    return future.select(
        *KEYS, "lines", "window_is_anomaly", F.col("y_future").alias("y_true"),
        (F.col("cents") / (F.col("cents") + F.lit(20000.0))).alias("proba"),
    )


def predictions(spark, sf):
    raw = scores(spark, sf).withColumn("predict_raw", alerts.raw_decision(F.col("proba"), THRESHOLD))
    return alerts.k_confirm(windows.keep_min_lines(raw, MIN_LINES), K)


def fixed_model(spark, sf, counts):
    """A model whose coefficients are a rule on the term, so SQL can state them."""
    n = counts.select(*KEYS).distinct().count()
    vocab = materialise(tfidf.vocabulary(counts, n), "vocab")
    code = (F.length("term") * 7 + F.ascii(F.col("term"))) % 11 - 5
    terms = vocab.select("term", "idf", (F.col("df") * 0).cast("int").alias("idx"), (code / 10.0).alias("coef"))
    numeric = [("lines", 2.0, 0.25), ("kw_error", 1.0, 0.5)]
    return model.Model(terms, numeric, -0.5, meta={"terms": vocab.count()}), n


# --- parse ----------------------------------------------------------------------

def _parsed(spark, sf, name):
    d = as_dialect(name)
    out = parse.parse_lines(rendered_lines(spark, sf, name), d)
    if d.carry_forward:
        out = parse.carry_forward(out)
    out = parse.parse_timestamps(out, d, rendered_year())
    return out.select("source_file", "line_no", "timestamp", "host", "process", "pid", "message", "raw", "ts")


def parse_syslog(spark, sf):
    return _parsed(spark, sf, "linux")


def parse_mac(spark, sf):
    return _parsed(spark, sf, "mac")


def parse_cbs_carry_forward(spark, sf):
    return _parsed(spark, sf, "windows")


def _log_files(spark, sf, name):
    """Rendered lines written as text files, then read as log files."""
    path = scratch_path(spark, "logs")
    (
        rendered_lines(spark, sf, name)
        .repartitionByRange("source_file", "line_no")
        .sortWithinPartitions("source_file", "line_no")
        .select(F.col("source_file").alias("log"), "raw")
        .write.partitionBy("log")
        .text(path)
    )
    got = read_logs(spark, path, name, rendered_year(), recursive=True, pattern="*.txt")
    host = F.regexp_extract("source_file", "log=([^/]+)/", 1)
    return got, host


def log_files_syslog(spark, sf):
    got, host = _log_files(spark, sf, "linux")
    return got.select(host.alias("log"), "timestamp", "host", "process", "pid", "message", "raw", "ts")


def log_files_numbering(spark, sf):
    """Line numbers of every file run from 1 to its line count."""
    got, host = _log_files(spark, sf, "windows")
    per_file = got.groupBy(host.alias("log"), "source_file").agg(
        F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"),
        F.count_distinct("line_no").alias("distinct_no"),
    )
    return per_file.groupBy("log").agg(
        F.sum("n").alias("lines"),
        F.min(((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("distinct_no") == F.col("n"))).cast("int")).alias("numbered"),
    )


def collected_events(spark, sf):
    d = as_dialect("linux")
    parsed = parse.parse_timestamps(parse.parse_lines(rendered_lines(spark, sf), d), d, rendered_year())
    stamped = parsed.withColumn("arrived", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return tables.collected_events(stamped, "linux", "file")


def dropped_lines(spark, sf):
    return parse.dropped_lines(parse_syslog(spark, sf))


# --- windows -------------------------------------------------------------------------

def window_counts(spark, sf):
    return windows.create_windows(lines(spark, sf), WIDTH).select(*KEYS, "lines", "kw_unique_procs")


def window_text(spark, sf):
    return windows.window_text(lines(spark, sf), WIDTH)


def window_examples(spark, sf):
    heads = windows.window_heads(lines(spark, sf), WIDTH)
    return heads.select(
        *KEYS, example_text(F.col("head")).alias("example_text"), example_text(F.col("head"), live=True).alias("live_text")
    )


def _keywords(name):
    def query(spark, sf):
        return windows.create_windows(lines(spark, sf, name), WIDTH, name).drop("proc_counts")

    return query


def keyword_totals(spark, sf):
    return windows.keyword_totals(windows.create_windows(lines(spark, sf), WIDTH))


def top_processes(spark, sf):
    grouped = windows.grouped_lines(lines(spark, sf), WIDTH, as_dialect("linux"), keywords=False)
    return windows.top_processes(grouped)


def process_counts(spark, sf):
    cut = windows.create_windows(lines(spark, sf), WIDTH, keywords=False)
    return cut.select(*KEYS, F.explode("proc_counts").alias("process", "n"))


def process_pivot(spark, sf):
    cut = windows.create_windows(lines(spark, sf), WIDTH, processes=PIVOT, keywords=False)
    return windows.widen_processes(cut, PIVOT)


def process_counts_long(spark, sf):
    return windows.process_counts_long(lines(spark, sf), WIDTH)


def min_lines_filter(spark, sf):
    return windows.keep_min_lines(window_counts(spark, sf), MIN_LINES)


# --- labels ---------------------------------------------------------------------------

def _labelled(name):
    def query(spark, sf):
        out = labels.label_windows(lines(spark, sf, name), WIDTH, name, keywords=False)
        return out.select(*KEYS, "lines", "window_is_anomaly", "window_label")

    return query


label_windows_linux = _labelled("linux")


def label_window_text(spark, sf):
    """The other way to the same labels: join the text, then search it."""
    out = labels.label_text(windows.window_text(lines(spark, sf), WIDTH), "linux")
    return out.select(*KEYS, "lines", "window_is_anomaly", "window_label")


def label_documents(spark, sf):
    docs = documents(spark, sf)
    return labels.label_text(docs, "windows", "text").select("doc_id", "window_label", "window_is_anomaly")


def label_distribution(spark, sf):
    return labels.label_distribution(label_windows_linux(spark, sf)).withColumn("share", r6("share"))


def anomaly_rate(spark, sf):
    return labels.anomaly_rate(label_windows_linux(spark, sf)).withColumn("rate", r6("rate"))


def window_anomaly(spark, sf):
    return labels.window_anomaly_from_lines(flagged_lines(spark, sf), WIDTH)


# --- trends and targets -------------------------------------------------------------------

def trend_features(spark, sf):
    cut = windows.create_windows(lines(spark, sf), WIDTH, processes=["kernel", "sshd"])
    wide = windows.widen_processes(cut, ["kernel", "sshd"]).select(*KEYS, "lines", "cnt_proc_kernel", "cnt_proc_sshd", "kw_error", "kw_unique_procs")
    out = trends.add_trends(wide)
    return out.select(*[r6(c).alias(c) if c.endswith("_mean") else F.col(c) for c in out.columns])


def align_features(spark, sf):
    cut = windows.create_windows(lines(spark, sf), WIDTH, processes=["kernel"])
    wide = windows.widen_processes(cut, ["kernel"])
    return trends.align_features(wide, ["cnt_proc_kernel", "cnt_proc_gone", "kw_error", "lines"]).select(
        *KEYS, "cnt_proc_kernel", "cnt_proc_gone", "kw_error", "lines"
    )


def future_labels(spark, sf):
    out = targets.future_labels(window_anomaly(spark, sf), HORIZON_MIN)
    return out.select(*KEYS, "window_is_anomaly", "y_future", "horizon_min")


def future_labels_rows(spark, sf):
    out = targets.future_labels_rows(window_anomaly(spark, sf), HORIZON_MIN, WIDTH_SEC)
    return out.select(*KEYS, "window_is_anomaly", "y_future", "horizon_min")


def legacy_anomaly_join(spark, sf):
    # windows without an anomaly have no flag, as in a table of anomalies alone
    flags = window_anomaly(spark, sf).where("window_is_anomaly = 1")
    return targets.join_anomaly_flags(window_counts(spark, sf), flags)


def future_label_summary(spark, sf):
    return targets.future_summary(future_labels(spark, sf))


def chronological_split(spark, sf):
    return targets.chronological_split(window_counts(spark, sf), 0.2)


def chronological_split_time(spark, sf):
    return targets.chronological_split(window_counts(spark, sf), 0.2, order="time")


def train_hygiene(spark, sf):
    split = targets.chronological_split(scores(spark, sf), 0.2)
    return targets.train_part(split).select(*KEYS, "lines", "y_true")


# --- alerts ---------------------------------------------------------------------------------

def k_confirm(spark, sf):
    return predictions(spark, sf).select(*KEYS, "predict_raw", "predict_confirmed")


def rising_edges(spark, sf):
    return alerts.rising_edges(predictions(spark, sf)).select(*KEYS, "predict_confirmed", "rise")


def alerts_by_day(spark, sf):
    return alerts.alerts_by_day(predictions(spark, sf))


def alerts_per_day(spark, sf):
    return alerts.alerts_per_day(predictions(spark, sf)).select(r6("alerts_per_day").alias("alerts_per_day"))


def prediction_summary(spark, sf):
    return alerts.prediction_summary(predictions(spark, sf))


def prediction_text(spark, sf):
    return live.prediction_text(predictions(spark, sf).withColumnRenamed("proba", "early_warning_score"))


def top_alerts(spark, sf):
    table = predictions(spark, sf).withColumnRenamed("proba", "early_warning_score")
    first = materialise(table.orderBy(F.desc("early_warning_score"), *KEYS).limit(20), "top_alerts")
    # example text is made for these windows only
    near = first.select(F.col("source_file").alias("_of"), F.col("bucket").alias("_at"))
    mine = F.expr("source_file = _of AND ts >= _at") & (F.col("ts") < F.col("_at") + F.expr(f"INTERVAL {width_seconds(WIDTH)} SECONDS"))
    heads = windows.window_heads(lines(spark, sf).join(F.broadcast(near), mine, "left_semi"), WIDTH)
    named = first.join(heads, KEYS).withColumn("example_text", example_text(F.col("head")))
    return alerts.top_alerts(named, 20).select(*KEYS, "alert_line")


def calibration_table(spark, sf):
    out = alerts.calibration_table(materialise(scores(spark, sf), "scores"), K)
    doubles = {"threshold", "alerts_per_day", "precision_k", "recall_k"}
    return out.select(*[r6(c).alias(c) if c in doubles else F.col(c) for c in out.columns])


def calibrate_alert_budget(spark, sf):
    out = alerts.calibrate_alert_budget(materialise(scores(spark, sf), "scores"), 1.0, K)
    doubles = {"threshold", "alerts_per_day", "precision_k", "recall_k"}
    return out.select(*[r6(c).alias(c) if c in doubles else F.col(c) for c in out.columns])


# --- evaluation -----------------------------------------------------------------------------

def pr_curve(spark, sf):
    out = evaluate.pr_curve(scores(spark, sf))
    return out.select(r6("threshold").alias("threshold"), "tp", "fp", r6("precision").alias("precision"), r6("recall").alias("recall"))


def average_precision(spark, sf):
    return evaluate.average_precision(scores(spark, sf)).select(r6("average_precision").alias("average_precision"))


def _judged(spark, sf):
    return predictions(spark, sf).withColumnRenamed("predict_raw", "y_pred")


def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_judged(spark, sf))


def classification_report(spark, sf):
    out = evaluate.classification_report(_judged(spark, sf))
    return out.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def classification_report_confirmed(spark, sf):
    out = evaluate.classification_report(predictions(spark, sf), pred="predict_confirmed")
    return out.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


def _threshold(policy, **kw):
    def query(spark, sf):
        out = evaluate.choose_threshold(scores(spark, sf), policy, **kw)
        return out.select(r6("threshold").alias("threshold"), "policy", "met_target")

    return query


# --- set operations ------------------------------------------------------------------------

def union_by_name(spark, sf):
    parts = [
        windows.create_windows(lines(spark, sf, n), WIDTH, n).drop("proc_counts").withColumn("os", F.lit(n))
        for n in DIALECTS
    ]
    merged = tables.union_tables(parts)
    # a count that a dialect does not have is null; shown as -1
    counts = [c for c in merged.columns if c.startswith("kw_") and c != "kw_unique_procs"]
    return merged.withColumns({c: F.coalesce(F.col(c), F.lit(-1)) for c in counts})


# --- text and explanation ---------------------------------------------------------------------

def tfidf_windows(spark, sf):
    # written once: vocabulary, number of windows and weights read it
    counts = materialise(tfidf.line_term_counts(lines(spark, sf), WIDTH), "counts")
    n = lines(spark, sf).select("source_file", windows.floor_bucket(F.col("ts"), WIDTH).alias("bucket")).distinct().count()
    vocab = tfidf.vocabulary(counts, n)
    return tfidf.weights(counts, vocab, KEYS).select(*KEYS, "term", "tf", r6("weight").alias("weight"))


def tfidf_documents(spark, sf):
    # the terms take many times the texts, so they are made twice rather than written or shuffled
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    dealt = tfidf.dealt_texts(docs, ["doc_id"], "text")
    vocab = materialise(tfidf.vocabulary(tfidf.text_term_counts(dealt, ["doc_id"], "text"), docs.count(), 2, 50_000), "vocab")
    counts = tfidf.text_term_counts(dealt, ["doc_id"], "text", vocab=vocab)
    return tfidf.weights(counts, vocab, ["doc_id"]).select("doc_id", "term", "tf", r6("weight").alias("weight"))


def _fitted(spark, sf):
    cut = materialise(windows.create_windows(lines(spark, sf), WIDTH, keywords=True).drop("proc_counts"), "windows")
    counts = materialise(tfidf.line_term_counts(lines(spark, sf), WIDTH), "counts")
    return cut, counts, fixed_model(spark, sf, counts)[0]


def _explained(spark, sf):
    cut, counts, fitted = _fitted(spark, sf)
    features = explain.long_features(fitted, cut, counts)
    coefs = explain.coefficient_table(fitted)
    features = materialise(features, "features")
    # the background is all explained windows
    means = materialise(explain.background_means(features, cut.agg(F.count("*")).scalar()), "means")
    phi = explain.contributions(features, coefs, means)
    absent = explain.absent_constants(coefs, means)
    return cut, phi, absent


def fixed_model_scores(spark, sf):
    cut, counts, fitted = _fitted(spark, sf)
    return model.score(fitted, cut, counts).select(*KEYS, r6("proba").alias("proba"))


def linear_attribution_topk(spark, sf):
    cut, phi, absent = _explained(spark, sf)
    top = explain.top_features(phi.withColumn("phi", F.round("phi", 9)), absent.withColumn("phi", F.round("phi", 9)), 5, cut)
    return top.select(*KEYS, F.posexplode("top").alias("pos", "t")).select(
        *KEYS, "pos", "t.feature", r6("t.phi").alias("phi")
    )


def explanation_text(spark, sf):
    cut, phi, absent = _explained(spark, sf)
    top = explain.top_features(phi.withColumn("phi", F.round("phi", 9)), absent.withColumn("phi", F.round("phi", 9)), 5, cut)
    rows = explain.explanation_rows(top, 3)
    return rows.select(*KEYS, *[c for i in (1, 2, 3) for c in (f"feature_{i}", f"shap_{i}")], "explanation")


def global_importance(spark, sf):
    cut, phi, absent = _explained(spark, sf)
    # every feature that some window holds; the length of the list is a parameter of the operator
    out = explain.global_importance(phi, absent, cut.agg(F.count("*")).scalar(), 1_000_000)
    # sums of opposite terms may differ in their last bits, so the sign is read from the rounded mean
    means = out.select("feature", r6("mean_abs_shap").alias("mean_abs_shap"), r6("mean_shap").alias("mean_shap"))
    return means.withColumn("direction", explain.direction(F.col("mean_shap")))


def sequence_windows(spark, sf):
    out = sequences.sequences(scores(spark, sf), "lines", SEQ_LEN, target="y_true")
    return out.select(*KEYS, F.array_join("sequence", ",").alias("sequence"), "label")


def explain_sample(spark, sf):
    return explain.sample_rows(window_counts(spark, sf), 200)


# --- live -----------------------------------------------------------------------------------

LIVE_TERMS = [("kernel", 1.5, 0.6), ("sshd", 1.25, -0.4), ("link up", 2.0, 0.3), ("timed", 2.5, 0.9), ("kernel job", 3.0, -0.7)]
LIVE_NUMERIC = [
    ("kw_error", 1.0, 0.5), ("kw_error_roll3_mean", 0.5, 0.2), ("kw_error_roll6_sum", 2.0, 0.1),
    ("cnt_proc_kernel_diff1", 1.0, -0.15), ("kw_unique_procs", 2.0, 0.05), ("lines", 4.0, 0.1),
]
LIVE_INTERCEPT = -0.6
LATENESS = "2 hours"


def _live(spark, sf, replay=False):
    """Rendered lines dropped as files, taken through the three live queries to the end of input.

    With ``replay`` the first batches of events and windows are written again in between, under
    new file names, as after a crash before their commit.
    """
    terms = spark.createDataFrame([(t, i, n, c) for n, (t, i, c) in enumerate(LIVE_TERMS)], "term string, idf double, idx int, coef double")
    fitted = model.Model(terms, LIVE_NUMERIC, LIVE_INTERCEPT, meta={"terms": len(LIVE_TERMS)})
    root = scratch_path(spark, "live")
    rendered_lines(spark, sf).repartitionByRange("source_file", "line_no").sortWithinPartitions(
        "source_file", "line_no"
    ).select("raw").write.text(f"{root}/landing")
    if replay:
        live.run_available(
            spark, f"{root}/landing", root, fitted, THRESHOLD, width=WIDTH, year=rendered_year(), k=K,
            min_lines=MIN_LINES, lateness=LATENESS,
        )
        for table, by in (("events", ["day"]), ("windows", [])):
            stored = materialise(spark.read.parquet(f"{root}/{table}"), "replay")
            for row in stored.select("batch").distinct().collect():
                again = stored.where(F.col("batch") == row.batch).drop("batch")
                again.write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{table}/batch={row.batch}")
    live.run_available(
        spark, f"{root}/landing", root, fitted, THRESHOLD, width=WIDTH, year=rendered_year(), k=K,
        min_lines=MIN_LINES, lateness=LATENESS, final=True,
    )
    return root


def live_windows(spark, sf):
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{_live(spark, sf)}/windows")
    return got.select(
        "source_file", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "lines", "kw_error", "kw_unique_procs",
        "cnt_proc_kernel", r6("text_logit").alias("text_logit"), "example_text",
    )


def live_alerts(spark, sf, replay=False):
    got = spark.read.parquet(f"{_live(spark, sf, replay)}/alerts")
    return got.select(
        "source_file", F.col("bucket").cast("timestamp_ntz").alias("bucket"), r6("early_warning_score").alias("early_warning_score"),
        "predict_raw", "predict_confirmed", "lines",
    )


def live_replayed(spark, sf):
    return live_alerts(spark, sf, replay=True)


def live_late_lines(spark, sf):
    """Every fiftieth line arrives after the windows of most others have closed."""
    terms = spark.createDataFrame([(t, i, n, c) for n, (t, i, c) in enumerate(LIVE_TERMS)], "term string, idf double, idx int, coef double")
    fitted = model.Model(terms, LIVE_NUMERIC, LIVE_INTERCEPT, meta={"terms": len(LIVE_TERMS)})
    root = scratch_path(spark, "late")
    for when, final in (("line_no % 50 <> 3", False), ("line_no % 50 = 3", True)):
        rendered_lines(spark, sf).where(when).select("raw").write.mode("append").text(f"{root}/landing")
        live.run_available(
            spark, f"{root}/landing", root, fitted, THRESHOLD, width=WIDTH, year=rendered_year(), k=K,
            min_lines=MIN_LINES, lateness=LATENESS, final=final,
        )
    got = live.late_lines(spark, f"{root}/events", f"{root}/windows", WIDTH).where("late > 0")
    return got.select("source_file", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "lines", "late")


def live_collected(spark, sf):
    root = scratch_path(spark, "collect")
    rendered_lines(spark, sf).repartitionByRange("source_file", "line_no").select("raw").write.text(f"{root}/landing")
    live.start_collector(
        spark, f"{root}/landing", f"{root}/events", f"{root}/_collect", year=rendered_year(), trigger=live.AVAILABLE
    ).awaitTermination()
    got = spark.read.parquet(f"{root}/events")
    ts = F.when(F.col("parsed"), F.col("ts").cast("timestamp_ntz"))
    return got.select(ts.alias("ts"), "host", "os", "source", "process", "pid", "message", "raw")


# --- whole pipeline -------------------------------------------------------------------------

def early_warning(spark, sf):
    """Parse, window, label, trends, targets and confirmed rule alerts."""
    d = as_dialect("linux")
    parsed = parse.parse_timestamps(parse.parse_lines(rendered_lines(spark, sf), d), d, rendered_year())
    # parsed once and written, as log files are; every later step reads the table
    parsed = materialise(parsed.select("source_file", "line_no", "ts", "process", "message"), "parsed")
    labelled = labels.label_windows(parsed, WIDTH, d, processes=["kernel"])
    wide = windows.widen_processes(labelled, ["kernel"]).select(
        *KEYS, "lines", "cnt_proc_kernel", "kw_error", "window_is_anomaly", "window_label"
    )
    out = targets.future_labels(trends.add_trends(wide), HORIZON_MIN)
    confirmed = alerts.k_confirm(out, K, "window_is_anomaly", "confirmed")
    return confirmed.select(
        *KEYS, "lines", "window_label", "window_is_anomaly", "kw_error", "kw_error_roll6_sum",
        "cnt_proc_kernel_diff1", "y_future", "confirmed",
    )


def _event_pipeline(spark, sf):
    # with many events an hour every window is anomalous, and no window is left to train on
    settings = pipeline.with_settings(width=WIDTH, horizon_min=HORIZON_MIN, min_lines=MIN_LINES, k_confirm=K, constant_model=True)
    prepared = pipeline.prepare(lines(spark, sf), "linux", settings)
    return prepared, settings


def train_and_score(spark, sf):
    prepared, settings = _event_pipeline(spark, sf)
    trained = pipeline.train(prepared, settings, eval_k=K)
    out = pipeline.score(prepared, trained.model, trained.threshold, settings)
    return out.withColumn("early_warning_score", r6("early_warning_score"))


def explain_model(spark, sf):
    prepared, settings = _event_pipeline(spark, sf)
    trained = pipeline.train(prepared, settings)
    rows, _ = pipeline.explain_windows(prepared, trained.model, settings)
    return rows


def svd_embedding(spark, sf):
    prepared, settings = _event_pipeline(spark, sf)
    return pipeline.sequence_set(prepared, length=SEQ_LEN)


def fit_certificate(spark, sf):
    """The fit's distance from the optimum, over all windows: all derivatives of the penalised loss are (nearly) 0."""
    prepared, settings = _event_pipeline(spark, sf)
    settings = pipeline.with_settings(settings, min_lines=0)
    out = pipeline.fit_certificate(prepared, pipeline.train(prepared, settings), settings)
    return out.select("windows", "positives", (F.col("largest_gradient") < 1e-4).alias("optimal"))


def svd_quality(spark, sf):
    """Size and orthonormality of the decomposition over the training windows."""
    prepared, settings = _event_pipeline(spark, sf)
    split = materialise(targets.chronological_split(prepared.windows, 0.2, check=False).select(*KEYS, "is_train"), "svd-split")
    terms, fitted = sequences.fitted_svd(split, prepared.counts, max_rounds=pipeline.SVD_ROUNDS)
    k = len(fitted.values)
    error = abs(svd.inner_products(fitted.factor, k) - np.eye(k)).max()
    energy = sum(v * v for v in fitted.values)
    train = split.where("is_train")
    filled = prepared.counts.join(terms, "term").join(train, KEYS, "left_semi").select(*KEYS).distinct()
    return train.agg(F.count("*").alias("windows")).select(
        "windows", F.lit(terms.count()).alias("terms"), F.lit(k).alias("components"), F.lit(bool(error < 1e-9)).alias("orthonormal"),
        # every filled row has length 1, so their number is the energy of the whole matrix
        (F.lit(energy) <= F.lit(filled.count() + 1e-6)).alias("within_energy"),
    )


# --- tables, files and bundles on disk -------------------------------------------------------

def stage_tables(spark, sf):
    """Window counts written in chunks and read back, as Parquet and as CSV."""
    parts = []
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, f"stage-{fmt}")
        rows = tables.write_table(window_counts(spark, sf), path, fmt, chunk_rows=500)
        back = tables.read_table(spark, path, "source_file string, bucket timestamp_ntz, lines long, kw_unique_procs long", fmt)
        parts.append(back.withColumns({"format": F.lit(fmt), "rows_written": F.lit(rows)}))
    return tables.union_tables(parts)


def merged_files(spark, sf):
    """Stage files of several folders, with different columns, as one table."""
    root = scratch_path(spark, "merge")
    for name in DIALECTS:
        cut = windows.create_windows(lines(spark, sf, name), WIDTH, name).drop("proc_counts", "source_file").withColumn("os", F.lit(name))
        tables.write_table(cut, f"{root}/{name}")
    merged = tables.merge_files(spark, root)
    counts = [c for c in merged.columns if c.startswith("kw_") and c != "kw_unique_procs"]
    return merged.select(F.split_part("source_file", F.lit("/"), F.lit(1)).alias("folder"), "os", "bucket", "lines", "kw_unique_procs", *[F.coalesce(c, F.lit(-1)).alias(c) for c in counts])


def files_by_source(spark, sf):
    """Predictions in a folder per source file, with as many files as its rows need."""
    path = scratch_path(spark, "by-source")
    tables.write_table(predictions(spark, sf), path, partition_by=("source_file",), chunk_rows=400)
    back = spark.read.parquet(path).select("source_file", "bucket", "predict_raw", F.col("_metadata.file_path").alias("file"))
    return back.groupBy("source_file").agg(F.count("*").alias("rows"), F.sum(F.col("predict_raw").cast("long")).alias("raw_positive"), F.count_distinct("file").alias("files"))


def bundle_round_trip(spark, sf):
    """A saved model and its thresholds, the latest of which counts."""
    cut, counts, fitted = _fitted(spark, sf)
    path = scratch_path(spark, "bundle")
    bundle.save_model(fitted, path)
    bundle.add_threshold(spark, path, 0.25, "precision")
    bundle.add_threshold(spark, path, THRESHOLD, "alert_budget", k_confirm=K)
    back, threshold = bundle.load_model(spark, path), bundle.load_threshold(spark, path)
    scored = model.score(back, cut, counts).withColumn("predict_raw", alerts.raw_decision(F.col("proba"), threshold))
    names = explain.feature_names(back).agg(F.count_distinct("feature")).scalar()
    return scored.select(*KEYS, r6("proba").alias("proba"), "predict_raw", F.lit(threshold).alias("threshold"), names.alias("features"))


def calibrated_predictions(spark, sf):
    """Scores judged again at the threshold of the alert budget."""
    table = materialise(scores(spark, sf), "scores")
    threshold = alerts.calibrate_alert_budget(table, 1.0, K).select("threshold").first().threshold
    raw = table.withColumn("predict_raw", alerts.raw_decision(F.col("proba"), threshold))
    return alerts.k_confirm(raw, K).select(*KEYS, "predict_raw", "predict_confirmed", r6(F.lit(threshold)).alias("threshold"))


def process_trend_features(spark, sf):
    """Counts and trends of every process that is among the top of some file, in long form."""
    cut = materialise(windows.create_windows(lines(spark, sf), WIDTH, keywords=False), "windows")
    return trends.process_features(cut).select(*KEYS, "feature", r6("x").alias("x"))


def explained_predictions(spark, sf):
    """Score and strongest feature of every window."""
    cut, phi, absent = _explained(spark, sf)
    top = explain.top_features(phi.withColumn("phi", F.round("phi", 9)), absent.withColumn("phi", F.round("phi", 9)), 1, cut)
    return top.join(fixed_model_scores(spark, sf), KEYS).select(*KEYS, F.col("proba").alias("prediction_score"), explain.explanation_text(F.col("top")).alias("explanation"))


def _in_utc(query):
    """Log times carry no zone; the engine reads them as UTC."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf)

    return run


def registry() -> dict:
    named = [
        early_warning, parse_syslog, parse_mac, parse_cbs_carry_forward, log_files_syslog, log_files_numbering,
        collected_events, dropped_lines, window_counts, window_text, window_examples, keyword_totals, top_processes,
        process_counts, process_pivot, process_counts_long, min_lines_filter, label_window_text, label_documents,
        label_distribution, anomaly_rate, window_anomaly, trend_features, align_features, future_labels,
        future_labels_rows, legacy_anomaly_join, future_label_summary, chronological_split, chronological_split_time,
        train_hygiene, k_confirm, rising_edges, alerts_by_day, alerts_per_day, prediction_summary, top_alerts,
        calibration_table, calibrate_alert_budget, pr_curve, average_precision, confusion_matrix,
        classification_report, classification_report_confirmed, union_by_name, tfidf_windows, tfidf_documents,
        fixed_model_scores, linear_attribution_topk, explanation_text, global_importance, sequence_windows,
        explain_sample, live_collected, live_windows, live_alerts, live_replayed, live_late_lines, train_and_score, explain_model, svd_embedding,
        fit_certificate, svd_quality, stage_tables, merged_files, files_by_source, bundle_round_trip, calibrated_predictions,
        process_trend_features, explained_predictions, prediction_text,
    ]
    out = {f.__name__: f for f in named}
    for name in DIALECTS:
        out[f"window_keywords_{name}"] = _keywords(name)
        out[f"label_windows_{name}"] = _labelled(name)
    out["threshold_precision"] = _threshold("precision", target_precision=0.5)
    out["threshold_precision_unmet"] = _threshold("precision", target_precision=1.1)
    out["threshold_percentile"] = _threshold("percentile", percentile=0.99)
    out["threshold_pr_max"] = _threshold("pr_max")
    out["threshold_min_score"] = _threshold("min_score")
    return {name: _in_utc(query) for name, query in out.items()}
