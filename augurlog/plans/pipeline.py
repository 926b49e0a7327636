"""The whole way from log files to confirmed, explained early warnings.

One table holds the windows of all files, keyed by ``source_file``; no stage loops
over files.  Written tables: parsed lines, windows (with labels, trends, targets),
term counts, model bundle, predictions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.functions.dialects import Dialect, dialect as as_dialect
from augurlog.functions.text import example_text
from augurlog.operators import alerts, evaluate, explain, labels, model as models, sequences, targets, tfidf, trends, windows
from augurlog.operators.windows import KEYS
from augurlog.session import materialise, scratch_path
from augurlog.sources import bundle
from augurlog.sources.logfiles import read_logs, read_parsed
from augurlog.sources.tables import write_table


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; the presets below are the usual combinations."""

    width: str = packs.DEFAULT_WINDOW
    horizon_min: int = packs.DEFAULT_HORIZON_MIN
    min_lines: int = packs.DEFAULT_MIN_LINES
    k_confirm: int = packs.DEFAULT_K_CONFIRM
    target_precision: float = packs.DEFAULT_TARGET_PRECISION
    use_trends: bool = True
    test_frac: float = 0.2
    split_order: str = "series"
    policy: str = "precision"
    percentile: float = 0.99
    ngram_max: int = 2
    max_features: int = packs.MAX_FEATURES
    year: int = packs.DEFAULT_YEAR
    encoding: str = "utf-8"
    errors: str = "replace"
    recursive: bool = False
    constant_model: bool = False


# --- fixed values: presets -----------------------------------------------------
STAGES = Settings()
RUNNER = Settings(width="5min", horizon_min=30, min_lines=3, k_confirm=2, target_precision=0.60, use_trends=False)
SINGLE_FILE = Settings(horizon_min=10, min_lines=3, k_confirm=2, target_precision=0.60)
SERVICING = Settings(min_lines=8, target_precision=0.92)


# Rounds of block power iteration for embeddings, as the usual randomised solver takes.
SVD_ROUNDS = 5


@dataclass
class Prepared:
    """Windows with features, labels and targets (process counts as a map); their process
    features in long form (``KEYS, feature, x``); term counts; first characters; processes."""

    windows: DataFrame
    numbers: DataFrame
    counts: DataFrame
    heads: DataFrame
    processes: DataFrame


def prepare(lines: DataFrame, dialect: str | Dialect, settings: Settings = STAGES, processes: DataFrame | None = None) -> Prepared:
    """Lines to windows.  ``processes`` is a fitted model's table; without it the
    processes are those found here."""
    d = as_dialect(dialect)
    cut = materialise(labels.label_windows(lines, settings.width, d, processes=processes), "labelled")
    if cut.isEmpty():
        raise ValueError("no line has a usable time; check the dialect and the year")
    found = processes if processes is not None else materialise(windows.process_vocabulary(cut), "processes")
    table = trends.add_trends(cut) if settings.use_trends else cut
    table = materialise(targets.future_labels(table, settings.horizon_min), "windows")
    numbers = materialise(trends.process_features(cut, settings.use_trends), "process-features")
    counts = materialise(tfidf.line_term_counts(lines, settings.width, settings.ngram_max), "term-counts")
    return Prepared(table, numbers, counts, windows.window_heads(lines, settings.width), found)


def fit_certificate(prepared: Prepared, trained: Trained, settings: Settings = STAGES) -> DataFrame:
    """``windows, positives, largest_gradient`` of the fit, over its training windows (see ``model.optimality``)."""
    model = trained.model
    scored = models.score(model, trained.train, prepared.counts, numbers=prepared.numbers)
    features = explain.long_features(model, trained.train, prepared.counts, prepared.numbers)
    return models.optimality(model, features, materialise(scored.select(*KEYS, "y_future", "proba"), "fitted-scores"), explain.coefficient_table(model))


@dataclass
class Trained:
    model: models.Model
    threshold: float
    val_scores: DataFrame
    average_precision: float
    report: DataFrame
    matrix: DataFrame
    confirmed_report: DataFrame | None
    train: DataFrame


def train(prepared: Prepared, settings: Settings = STAGES, eval_k: int = 0) -> Trained:
    """Filter, split in order, drop windows anomalous now, fit, choose a threshold, report.

    Busy logs may leave one class or no window behind the third step: an error, or with
    ``constant_model`` a model that is a constant (see ``model.fit``); ``meta["classes"]`` tells.
    """
    table = windows.keep_min_lines(prepared.windows, settings.min_lines)
    table = table.withColumn("y_future", targets.clean_flag(F.col("y_future")))
    split = materialise(targets.chronological_split(table, settings.test_frac, order=settings.split_order), "split")
    train_rows = targets.train_part(split)
    fitted = models.fit(
        train_rows,
        prepared.counts,
        trends.numeric_features(prepared.windows.drop("window_is_anomaly", "y_future", "horizon_min")),
        max_features=settings.max_features,
        numbers=prepared.numbers,
        constant=settings.constant_model,
    )
    fitted.processes = prepared.processes
    test = targets.test_part(split)
    scored = models.score(fitted, test, prepared.counts, numbers=prepared.numbers).select(
        *KEYS, "lines", "proba", F.col("y_future").alias("y_true")
    )
    val = materialise(scored, "val-scores")
    chosen = evaluate.choose_threshold(val, settings.policy, settings.target_precision, settings.percentile).first()
    judged = materialise(val.withColumn("y_pred", alerts.raw_decision(F.col("proba"), chosen.threshold)), "judged")
    ap = evaluate.average_precision(val).first().average_precision
    confirmed = None
    if eval_k > 1:
        confirmed = evaluate.classification_report(
            alerts.k_confirm(judged, eval_k, "y_pred", "y_conf"), pred="y_conf"
        )
    fitted.meta.update(
        policy=settings.policy, target_precision=settings.target_precision, threshold=chosen.threshold,
        average_precision=ap, min_lines=settings.min_lines, test_rows=val.count(),
        positive_test=val.where("y_true = 1").count(), width=settings.width,
    )
    return Trained(
        fitted, chosen.threshold, val, ap,
        evaluate.classification_report(judged), evaluate.confusion_matrix(judged), confirmed, train_rows,
    )


def save(trained: Trained, path: str, settings: Settings = STAGES) -> None:
    """Write the model bundle."""
    bundle.save_model(trained.model, path)
    bundle.save_table(trained.val_scores, path, "val_scores")
    bundle.save_table(trained.report, path, "metrics_report")
    bundle.save_table(trained.matrix, path, "metrics_matrix")
    if trained.confirmed_report is not None:
        bundle.save_table(trained.confirmed_report, path, "metrics_report_confirmed")
    bundle.add_threshold(
        trained.val_scores.sparkSession, path, trained.threshold, settings.policy,
        target_precision=settings.target_precision, average_precision=trained.average_precision,
    )


def score(prepared: Prepared, model: models.Model, threshold: float, settings: Settings = STAGES) -> DataFrame:
    """Predictions: filter by lines, score, decide, confirm (in this order), show."""
    kept = windows.keep_min_lines(prepared.windows, settings.min_lines)
    scored = models.score(model, kept, prepared.counts, "early_warning_score", prepared.numbers)
    k = max(1, settings.k_confirm)
    decided = scored.withColumn("predict_raw", alerts.raw_decision(F.col("early_warning_score"), threshold))
    out = alerts.k_confirm(decided, k).join(prepared.heads, KEYS, "left")
    return out.select(
        *KEYS, "early_warning_score", "predict_raw", "predict_confirmed",
        F.lit(threshold).alias("threshold"), F.lit(k).alias("k_confirm"), "lines",
        example_text(F.coalesce("head", F.lit(""))).alias("example_text"),
    )


def calibrate(spark: SparkSession, path: str, target_alerts_per_day: float = 3.0, k: int = packs.DEFAULT_K_CONFIRM) -> DataFrame:
    """Choose the bundle's threshold for an alert budget; scoring uses it from then on."""
    best = alerts.calibrate_alert_budget(spark.read.parquet(f"{path}/val_scores"), target_alerts_per_day, k)
    bundle.save_table(best, path, "calibration")
    row = spark.read.parquet(f"{path}/calibration").first()
    if row is None:
        raise ValueError(f"no validation scores in {path}")
    bundle.add_threshold(
        spark, path, row.threshold, "alert_budget", target_alerts_per_day=target_alerts_per_day,
        alerts_per_day=row.alerts_per_day, k_confirm=k,
    )
    return spark.read.parquet(f"{path}/calibration")


def explain_windows(
    prepared: Prepared, model: models.Model, settings: Settings = STAGES, top_k: int = 5, sample: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(explanation rows, global importance).  ``sample`` limits the rows explained,
    if wanted; the method itself needs no limit."""
    kept = windows.keep_min_lines(prepared.windows, settings.min_lines)
    if sample:
        kept = explain.sample_rows(kept, sample)
    kept = materialise(kept, "explained")
    n = kept.agg(F.count("*")).scalar()
    features = materialise(explain.long_features(model, kept, prepared.counts, prepared.numbers), "features")
    coefs = explain.coefficient_table(model)
    means = materialise(explain.background_means(features, n), "means")
    phi = explain.contributions(features, coefs, means)
    absent = explain.absent_constants(coefs, means)
    top = explain.top_features(phi, absent, top_k, kept)
    scored = models.score(model, kept, prepared.counts, "prediction_score", prepared.numbers).select(*KEYS, "prediction_score")
    rows = explain.explanation_rows(top.join(scored, KEYS), top_k)
    return rows, explain.global_importance(phi, absent, n, 30)


def sequence_set(
    prepared: Prepared, n_components: int = 256, length: int = 6, test_frac: float = 0.2, max_features: int = packs.MAX_FEATURES, max_rounds: int = SVD_ROUNDS
) -> DataFrame:
    """``KEYS, sequence, label, is_train``: embedded windows as sequences for a temporal model."""
    split = targets.chronological_split(prepared.windows, test_frac, check=False)
    keyed = materialise(split.select(*KEYS, "is_train", "y_future"), "seq-split")
    dense = sequences.svd_embedding(keyed, prepared.counts, n_components, max_features=max_features, max_rounds=max_rounds)
    rows = dense.join(keyed, KEYS)
    parts = [
        sequences.sequences(rows.where(cond), "embedding", length).withColumn("is_train", F.lit(flag))
        for cond, flag in ((F.col("is_train"), True), (~F.col("is_train"), False))
    ]
    return parts[0].unionByName(parts[1])


@dataclass
class Run:
    prepared: Prepared
    trained: Trained
    predictions: DataFrame


def run_pipeline(
    spark: SparkSession,
    path: str | list[str],
    dialect: str | Dialect,
    out: str | None = None,
    settings: Settings = RUNNER,
    target_alerts_per_day: float | None = None,
) -> Run:
    """Log files, or ``.csv`` files of parsed lines, to predictions; with ``out`` everything is written below it."""
    if all(p.lower().endswith(".csv") for p in ([path] if isinstance(path, str) else path)):
        lines = read_parsed(spark, path, dialect, settings.year)
    else:
        lines = read_logs(
            spark, path, dialect, settings.year, settings.recursive, encoding=settings.encoding, errors=settings.errors
        )
    prepared = prepare(materialise(lines, "lines"), dialect, settings)
    trained = train(prepared, settings)
    out = out or scratch_path(spark, "run")
    save(trained, f"{out}/model", settings)
    if target_alerts_per_day is not None:
        calibrate(spark, f"{out}/model", target_alerts_per_day, settings.k_confirm)
    threshold = bundle.load_threshold(spark, f"{out}/model")
    write_table(score(prepared, trained.model, threshold, settings), f"{out}/predictions", partition_by=("source_file",))
    prepared.windows.write.mode("overwrite").parquet(f"{out}/windows")
    return Run(prepared, trained, spark.read.parquet(f"{out}/predictions"))


def with_settings(base: Settings = STAGES, **changes) -> Settings:
    return replace(base, **changes)
