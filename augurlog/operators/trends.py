"""Rolling trends over the windows of a series, and column roles by name.

Frames count rows that exist, per source file; ``series.over_rows`` computes them in blocks of
weeks, so no task walks a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from augurlog.operators.series import over_rows
from augurlog.operators.windows import KEYS, require

SUFFIXES = ("_roll3_mean", "_roll6_sum", "_diff1")


def trend_base_columns(df: DataFrame) -> list[str]:
    """Count columns that get trends: processes first, then keywords."""
    base = [c for c in df.columns if not c.endswith(SUFFIXES)]
    return [c for c in base if c.startswith("cnt_proc_")] + [c for c in base if c.startswith("kw_")]


def add_trends(windows: DataFrame, series: str = "source_file") -> DataFrame:
    """Add ``_roll3_mean``, ``_roll6_sum`` and ``_diff1`` for every count column."""
    require(windows, "bucket", series)
    base = trend_base_columns(windows)
    if not base:
        return windows

    def rolled(order: WindowSpec) -> dict:
        out = {}
        for c in base:
            x = F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("double")
            out[f"{c}_roll3_mean"] = F.avg(x).over(order.rowsBetween(-2, 0))
            out[f"{c}_roll6_sum"] = F.sum(x).over(order.rowsBetween(-5, 0))
            out[f"{c}_diff1"] = F.coalesce(x - F.lag(x).over(order), F.lit(0.0))
        return out

    return over_rows(windows, rolled, before=5, series=series)


def process_features(windows: DataFrame, trends: bool = True) -> DataFrame:
    """``KEYS, feature, x``: process counts, and their trends, in long form; zeros are left out.

    The same features as ``cnt_proc_*`` columns with ``add_trends``, for any number of processes.
    A count reaches the trends of its own window and of the five windows after it, so each entry
    of ``proc_counts`` is handed on to those that exist and the features are sums over what a
    window was handed: a window gets them also where it has no line of the process.
    """
    require(windows, *KEYS, "proc_counts")
    named = lambda suffix: F.concat(F.lit("cnt_proc_"), "process", F.lit(suffix))
    if not trends:
        entries = windows.select(*KEYS, F.explode("proc_counts").alias("process", "x"))
        return entries.select(*KEYS, named("").alias("feature"), F.col("x").cast("double").alias("x")).where("x <> 0")

    def neighbours(order: WindowSpec) -> dict:
        # the windows an entry counts for, and the place of the own window, as far as it matters
        return {"_to": F.collect_list(F.struct("bucket")).over(order.rowsBetween(0, 5)), "_place": F.count(F.lit(1)).over(order.rowsBetween(-2, 0))}

    placed = over_rows(windows.select(*KEYS, "proc_counts"), neighbours, before=2, after=5)
    entries = placed.select("source_file", "_to", "_place", F.explode("proc_counts").alias("process", "n")).where("n <> 0")
    handed = entries.select("source_file", "process", "n", "_place", F.posexplode("_to").alias("_ago", "_at"))
    n = F.col("n").cast("double")
    at = lambda *ago: F.coalesce(F.sum(F.when(F.col("_ago").isin(*ago), n)), F.lit(0.0))
    sums = handed.groupBy("source_file", F.col("_at.bucket").alias("bucket"), "process").agg(
        at(0).alias("now"), at(1).alias("was"), at(0, 1, 2).alias("last3"), F.sum(n).alias("last6"),
        # rows of the window's last three that exist
        F.max(F.least(F.col("_place") + F.col("_ago"), F.lit(3))).alias("rows"),
    )
    values = {"": F.col("now"), "_roll3_mean": F.col("last3") / F.col("rows"), "_roll6_sum": F.col("last6"), "_diff1": F.when(F.col("rows") == 1, 0.0).otherwise(F.col("now") - F.col("was"))}
    cells = F.array(*[F.struct(named(s).alias("feature"), v.alias("x")) for s, v in values.items()])
    return sums.select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.feature", "c.x").where("x <> 0")


def numeric_features(df: DataFrame) -> list[str]:
    """Model inputs by name and type, in table order, ``lines`` last."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    named = lambda c: c.startswith(("cnt_proc_", "kw_")) or "_roll" in c or "_diff" in c
    picked = [c for c in df.columns if named(c) and c in numeric]
    if "lines" in numeric:
        picked.append("lines")
    return list(dict.fromkeys(picked))


def base_of(feature: str) -> str:
    """The count column a feature is derived from."""
    for suffix in SUFFIXES:
        if feature.endswith(suffix):
            return feature[: -len(suffix)]
    return feature


def expected_inputs(features: list[str]) -> tuple[list[str], list[str]]:
    """Processes and keywords a feature list needs: ``(processes, keywords)``."""
    bases = list(dict.fromkeys(base_of(f) for f in features))
    procs = [b[len("cnt_proc_"):] for b in bases if b.startswith("cnt_proc_")]
    return procs, [b for b in bases if b.startswith("kw_")]


def align_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Give ``df`` every feature of a model: missing columns and nulls become 0."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in features]
    have = set(df.columns)
    aligned = [
        (F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
        for c in features
    ]
    return df.select(*keep, *aligned)
