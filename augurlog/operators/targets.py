"""Prediction targets, train/test split and train hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.operators.ordered import exact_quantiles, global_rank
from augurlog.operators.series import over_rows
from augurlog.operators.windows import require
from augurlog.session import materialise

# Smallest parts a split may leave.
MIN_TRAIN_ROWS = 50
MIN_TEST_ROWS = 10


def clean_flag(col: Column) -> Column:
    """Null to 0, whole number, clipped to 0/1."""
    return F.least(F.greatest(F.coalesce(col.cast("int"), F.lit(0)), F.lit(0)), F.lit(1))


def future_labels(
    labelled: DataFrame, horizon_min: int = packs.DEFAULT_HORIZON_MIN, series: str = "source_file"
) -> DataFrame:
    """``y_future`` = 1 if an anomaly starts after ``t`` and no later than ``t + horizon``.

    A series is cut into time blocks at least one horizon long; the windows of a
    block's following horizon are copied in as a margin and dropped again, so a
    block decides its own rows and a long series is not one task.
    """
    require(labelled, "bucket", "window_is_anomaly", series)
    horizon = horizon_min * 60
    block = max(horizon, 86_400)
    flagged = (
        labelled.where(F.col("bucket").isNotNull())
        .withColumn("window_is_anomaly", clean_flag(F.col("window_is_anomaly")))
        .withColumn("_t", F.unix_seconds(F.col("bucket").cast("timestamp")))
    )
    home = F.floor(F.col("_t") / F.lit(block))
    margin = F.floor((F.col("_t") - F.lit(horizon)) / F.lit(block))
    ahead = (
        Window.partitionBy(series, "_block").orderBy("_t").rangeBetween(1, horizon)
        if horizon > 0
        else None
    )
    if ahead is None:
        y = F.lit(0)
    else:
        y = F.coalesce(F.max("window_is_anomaly").over(ahead), F.lit(0))
    place = lambda block_no, own: F.struct(block_no.alias("block"), F.lit(own).alias("own"))
    # Only anomalous windows matter as a margin.
    in_margin = (F.col("window_is_anomaly") == 1) & (margin != home)
    places = F.when(in_margin, F.array(place(home, True), place(margin, False))).otherwise(
        F.array(place(home, True))
    )
    return (
        flagged.withColumn("_place", F.explode(places))
        .withColumn("_block", F.col("_place.block"))
        .withColumn("y_future", y)
        .where(F.col("_place.own"))
        .withColumn("horizon_min", F.lit(horizon_min))
        .drop("_t", "_block", "_place")
    )


def future_labels_rows(
    labelled: DataFrame, horizon_min: int = 10, window_sec: int = 60, series: str = "source_file"
) -> DataFrame:
    """Older form: the horizon is a number of rows, ``horizon / window``."""
    require(labelled, "bucket", "window_is_anomaly", series)
    n = horizon_min * 60 // window_sec
    flag = clean_flag(F.col("window_is_anomaly"))
    labelled = labelled.withColumn("window_is_anomaly", flag)
    ahead = lambda rows: {"y_future": F.coalesce(F.max("window_is_anomaly").over(rows.rowsBetween(1, n)), F.lit(0))}
    out = over_rows(labelled, ahead, after=n, series=series) if n > 0 else labelled.withColumn("y_future", F.lit(0))
    return out.withColumn("horizon_min", F.lit(horizon_min))


def join_anomaly_flags(windows: DataFrame, flags: DataFrame) -> DataFrame:
    """Left join of separately made anomaly flags on the window key; absent = 0."""
    keys = [k for k in ("source_file", "bucket") if k in windows.columns and k in flags.columns]
    return windows.join(flags.select(*keys, "window_is_anomaly"), keys, "left").withColumn(
        "window_is_anomaly", F.coalesce(F.col("window_is_anomaly").cast("int"), F.lit(0))
    )


def future_summary(future: DataFrame, series: str = "source_file") -> DataFrame:
    """``windows, anomalies, positives, median_gap_sec`` (gap to the previous window)."""
    future = materialise(future.select(series, "bucket", "window_is_anomaly", "y_future"), "future")
    seconds = F.unix_seconds(F.col("bucket").cast("timestamp"))
    gap = lambda rows: {"gap": (seconds - F.lag(seconds).over(rows)).cast("double")}
    gaps = over_rows(future.select(series, "bucket"), gap, before=1, series=series).select("gap")
    median = exact_quantiles(gaps, "gap", [0.5]).select("quantile").scalar()
    return future.agg(
        F.count("*").alias("windows"),
        F.sum(F.col("window_is_anomaly").cast("long")).alias("anomalies"),
        F.sum(F.col("y_future").cast("long")).alias("positives"),
    ).withColumn("median_gap_sec", median)


def chronological_split(
    df: DataFrame, test_frac: float = 0.2, series: str = "source_file", order: str = "series", check: bool = True
) -> DataFrame:
    """Add ``is_train``: the first ``int(n * (1 - test_frac))`` rows in order.

    ``order="series"`` walks file after file (the pooled table's order),
    ``order="time"`` walks all files by bucket.  With ``check`` a split that leaves
    too few rows on one side is an error.
    """
    rows = df.count()
    cut = int(rows * (1 - test_frac))
    if check and (cut < MIN_TRAIN_ROWS or cut >= rows - MIN_TEST_ROWS):
        raise ValueError(f"a split at row {cut} of {rows} leaves too few rows on one side")
    if order == "series":
        ranked = global_rank(df, series, "bucket")
    else:
        ranked = global_rank(df, "bucket", series)
    return ranked.withColumn("is_train", F.col("row_no") <= cut).drop("row_no")


def train_part(split: DataFrame) -> DataFrame:
    """Training rows without windows that are anomalous now: the model is to see
    what comes before an anomaly, not the anomaly itself."""
    train = split.where("is_train")
    if "window_is_anomaly" not in split.columns:
        return train
    return train.where(F.coalesce(F.col("window_is_anomaly").cast("int"), F.lit(0)) == 0)


def test_part(split: DataFrame) -> DataFrame:
    """Test rows, left as they are."""
    return split.where(~F.col("is_train"))
