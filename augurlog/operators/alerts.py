"""From scores to alerts: decision, confirmation, rising edges, alert budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.operators.ordered import exact_quantiles
from augurlog.operators.series import over_rows
from augurlog.operators.windows import require

# --- fixed values: the calibration grid (quantile levels of the scores) -------
GRID_FROM, GRID_TO, GRID_POINTS = 0.50, 0.999, 100


def raw_decision(score: Column, threshold: Column | float) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= t).cast("int")


def k_confirm(
    df: DataFrame,
    k: int = packs.DEFAULT_K_CONFIRM,
    flag: str = "predict_raw",
    out: str = "predict_confirmed",
    series: str = "source_file",
) -> DataFrame:
    """1 if this row and the ``k - 1`` rows before it are all 1 (``k <= 1``: unchanged)."""
    if k <= 1:
        return df.withColumn(out, F.col(flag).cast("int"))
    ones = lambda rows: F.sum(F.col(flag).cast("long")).over(rows.rowsBetween(-(k - 1), 0))
    return over_rows(df, lambda rows: {out: (ones(rows) >= k).cast("int")}, before=k - 1, series=series)


def rising_edges(
    df: DataFrame, flag: str = "predict_confirmed", out: str = "rise", series: str = "source_file"
) -> DataFrame:
    """1 where the flag turns from 0 to 1; the first row of a series never does."""
    turned = lambda rows: (F.col(flag) == 1) & (F.lag(flag).over(rows) == 0)
    return over_rows(df, lambda rows: {out: F.coalesce(turned(rows), F.lit(False)).cast("int")}, before=1, series=series)


def alerts_by_day(df: DataFrame, flag: str = "predict_confirmed", series: str = "source_file") -> DataFrame:
    """``day, alerts``: rising edges per calendar day, for days that have windows."""
    require(df, "bucket", flag, series)
    return (
        rising_edges(df, flag, "_rise", series)
        .groupBy(F.to_date("bucket").alias("day"))
        .agg(F.sum("_rise").alias("alerts"))
    )


def alerts_per_day(df: DataFrame, flag: str = "predict_confirmed", series: str = "source_file") -> DataFrame:
    """Mean alerts over the days that have windows; 0 if there are none."""
    return alerts_by_day(df, flag, series).agg(
        F.coalesce(F.avg("alerts"), F.lit(0.0)).alias("alerts_per_day")
    )


def prediction_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count("*").alias("windows"),
        F.coalesce(F.sum(F.col("predict_raw").cast("long")), F.lit(0)).alias("raw_positive"),
        F.coalesce(F.sum(F.col("predict_confirmed").cast("long")), F.lit(0)).alias("confirmed_positive"),
    )


def alert_line() -> Column:
    """One printable line per prediction."""
    return F.format_string(
        "%s  score=%.4f  raw=%d  conf=%d  lines=%d  %s",
        F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"),
        F.col("early_warning_score"),
        F.col("predict_raw"),
        F.col("predict_confirmed"),
        F.col("lines"),
        F.translate(F.substring(F.col("example_text"), 1, 120), "\n", " "),
    )


def top_alerts(predictions: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest scores (ties by file and bucket) with their printable line."""
    keys = [c for c in ("source_file", "bucket") if c in predictions.columns]
    return (
        predictions.orderBy(F.desc("early_warning_score"), *keys).limit(n).withColumn("alert_line", alert_line())
    )


def grid_levels() -> list[float]:
    step = (GRID_TO - GRID_FROM) / (GRID_POINTS - 1)
    return [GRID_FROM + i * step for i in range(GRID_POINTS - 1)] + [GRID_TO]


def threshold_grid(scores: DataFrame, score: str = "proba") -> list[float]:
    """Distinct score quantiles, increasing.  At most ``GRID_POINTS`` numbers."""
    rows = exact_quantiles(scores, score, grid_levels()).select("quantile").distinct().collect()
    return sorted(r.quantile for r in rows)


def calibration_table(
    scores: DataFrame,
    k: int = packs.DEFAULT_K_CONFIRM,
    score: str = "proba",
    target: str = "y_true",
    series: str = "source_file",
    grid: list[float] | None = None,
) -> DataFrame:
    """Every grid threshold with its alerts per day and confirmed tp / fp / fn.

    A window is confirmed at threshold ``t`` exactly when the smallest of its last
    ``k`` scores, ``m``, is at least ``t``; it is a rising edge when also the
    previous window's ``m`` is below ``t``.  So one pass finds, per window, the run
    of grid thresholds it counts for, and everything else is sums over at most
    ``GRID_POINTS + 1`` grid places, however many windows there are.
    """
    require(scores, score, target, "bucket", series)
    grid = grid if grid is not None else threshold_grid(scores, score)
    k = max(1, k)
    points = F.array(*[F.lit(float(t)) for t in grid])
    # how many grid thresholds are <= m, i.e. at how many the window is confirmed
    places = lambda m: F.when(m.isNull(), 0).otherwise(F.size(F.filter(points, lambda t: t <= m)))

    def smallest(rows) -> dict:
        of = lambda frame: F.when(F.count("_s").over(frame) >= k, F.min("_s").over(frame))
        return {"_m": of(rows.rowsBetween(-(k - 1), 0)), "_m_before": of(rows.rowsBetween(-k, -1)), "_has_prev": F.lag(F.lit(1)).over(rows)}

    thin = scores.select(F.to_date("bucket").alias("_day"), F.col(target).alias("_y"), F.col(score).alias("_s"), series, "bucket")
    per_window = (
        over_rows(thin, smallest, before=k, series=series)
        .withColumn("_up", places(F.col("_m")))
        .withColumn("_before", F.when(F.col("_has_prev").isNull(), F.col("_up")).otherwise(places(F.col("_m_before"))))
    )
    # Place p means: confirmed at the p lowest thresholds.
    by_place = per_window.groupBy("_up", "_before").agg(
        F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg"), F.count("*").alias("_n")
    )
    days = per_window.agg(F.count_distinct("_day")).scalar()
    positives = per_window.agg(F.count_if(F.col("_y") == 1)).scalar()
    # (up, before) pairs are at most (GRID_POINTS + 1)^2 rows; open them over the grid
    index = F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("_i")
    opened = by_place.select("*", index)
    confirmed = F.col("_i") <= F.col("_up")
    table = opened.groupBy("_i").agg(
        F.coalesce(F.sum(F.when(confirmed & (F.col("_i") > F.col("_before")), F.col("_n"))), F.lit(0)).alias("rises"),
        F.coalesce(F.sum(F.when(confirmed, F.col("_pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(confirmed, F.col("_neg"))), F.lit(0)).alias("fp"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return table.select(
        F.element_at(points, F.col("_i")).alias("threshold"),
        ratio(F.col("rises"), days).alias("alerts_per_day"),
        "tp",
        "fp",
        (positives - F.col("tp")).alias("fn"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_k"),
        ratio(F.col("tp"), positives).alias("recall_k"),
    )


def calibrate_alert_budget(
    scores: DataFrame,
    target_alerts_per_day: float = 3.0,
    k: int = packs.DEFAULT_K_CONFIRM,
    **columns,
) -> DataFrame:
    """The grid threshold whose alerts per day come closest to the budget (ties: higher)."""
    return (
        calibration_table(scores, k, **columns)
        .orderBy(F.abs(F.col("alerts_per_day") - F.lit(float(target_alerts_per_day))), F.desc("threshold"))
        .limit(1)
        .withColumn("target_alerts_per_day", F.lit(float(target_alerts_per_day)))
        .withColumn("k_confirm", F.lit(k))
    )
