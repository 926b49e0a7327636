"""Rule labels for windows: the first matching rule names the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.functions.dialects import Dialect, dialect as as_dialect
from augurlog.functions.rules import chains, decomposable, match_sql, matches, quoted
from augurlog.functions.text import line_text
from augurlog.operators.windows import KEYS, LINE_POSITION, bucketed, grouped_lines, merge_groups, require, window_text
from augurlog.session import broadcast_if_small, materialise

NORMAL = "NORMAL"


def label_of_text(text: str, rules) -> Column:
    """First matching rule over a whole text column; ``NORMAL`` if none or no text."""
    return _first_of([(name, match_sql(text, pattern)) for name, pattern in rules])


def _first_of(arms: list[tuple[str, str]]) -> Column:
    if not arms:
        return F.lit(NORMAL)
    cases = " ".join(f"WHEN {test} THEN {quoted(name)}" for name, test in arms)
    return F.expr(f"CASE {cases} ELSE {quoted(NORMAL)} END")


def with_flag(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "window_is_anomaly", F.when(F.col("window_label") != NORMAL, 1).otherwise(0)
    )


def label_text(windows: DataFrame, dialect: str | Dialect = "linux", text_col: str = "text_with_proc") -> DataFrame:
    """Label windows that already carry their text."""
    require(windows, text_col)
    d = as_dialect(dialect)
    return with_flag(windows.withColumn("window_label", label_of_text(f"`{text_col}`", d.rules)))


def _three_part(d: Dialect):
    return [
        (i, j, atoms)
        for i, (_, pattern) in enumerate(d.rules)
        for j, atoms in enumerate(chains(pattern))
        if len(atoms) == 3
    ]


def _middle_open(i: int, j: int) -> Column:
    """A and C stand in order, and it is not yet known if some B stands between.

    The outermost B positions settle most windows: one of them is between, or all
    of them are on one side.
    """
    t = f"_r{i}_{j}"
    return F.expr(
        f"coalesce({t}_a_min < {t}_z_max AND {t}_b_min <= {t}_a_min AND {t}_b_max >= {t}_z_max, false)"
    )


def _chain_hit(i: int, j: int, atoms: list[str]) -> list[str]:
    """Tests of which one holds when the parts stand in order across lines."""
    t = f"_r{i}_{j}"
    if len(atoms) == 1:
        return []
    if len(atoms) == 2:
        return [f"{t}_a_min < {t}_z_max"]
    return [
        f"{t}_ab_min < {t}_z_max",
        f"{t}_a_min < {t}_bz_max",
        f"({t}_a_min < {t}_b_min AND {t}_b_min < {t}_z_max)",
        f"({t}_a_min < {t}_b_max AND {t}_b_max < {t}_z_max)",
        f"_mid{i}_{j}",
    ]


def _resolve_middles(windows: DataFrame, lines: DataFrame, width: str, d: Dialect) -> DataFrame:
    """Add ``_mid{i}_{j}`` for three-part chains.

    Only windows left open by the outermost positions are looked up again, and
    only if there are any: the lines that hold the middle part are joined with one
    narrow row per open window.
    """
    parts = _three_part(d)
    if not parts:
        return windows
    is_open = windows.agg(*[F.max(_middle_open(i, j)) for i, j, _ in parts]).first()
    for (i, j, atoms), found in zip(parts, is_open):
        flag = f"_mid{i}_{j}"
        if not found:
            windows = windows.withColumn(flag, F.lit(False))
            continue
        open_windows = windows.where(_middle_open(i, j)).select(
            *KEYS, F.col(f"_r{i}_{j}_a_min").alias("_a"), F.col(f"_r{i}_{j}_z_max").alias("_z")
        )
        inner = (
            bucketed(lines, width)
            .withColumn("_line", line_text(F.col("process"), F.col("message")))
            .where(matches("_line", atoms[1]))
            .select(*KEYS, F.expr(LINE_POSITION).alias("_pos"))
            .join(broadcast_if_small(open_windows), KEYS)
            .where((F.col("_a") < F.col("_pos")) & (F.col("_pos") < F.col("_z")))
            .groupBy(*KEYS)
            .agg(F.lit(True).alias(flag))
        )
        windows = windows.join(inner, KEYS, "left")
    return windows


def label_windows(
    lines: DataFrame,
    width: str = packs.DEFAULT_WINDOW,
    dialect: str | Dialect = "linux",
    processes: list[str] | None = None,
    keywords: bool = True,
) -> DataFrame:
    """Windows with features, ``window_is_anomaly`` and ``window_label``.

    Same result as joining each window's lines and searching the joined text,
    without joining them.  ``lines`` should be a written table (``read_logs`` gives
    one): a filter on fields still being parsed would repeat the parsing.  A dialect with rules
    that ``rules.chains`` cannot read line by line (such as chains of more than three parts) is
    labelled by the joined text, as ``window_text`` and ``label_text`` do it.
    """
    d = as_dialect(dialect)
    if not all(decomposable(pattern) for _, pattern in d.rules):
        features = merge_groups(grouped_lines(lines, width, d, keywords), d, processes, keywords)
        text = window_text(lines, width).select(*KEYS, "text_with_proc")
        return label_text(features.join(text, KEYS, "left"), d).drop("text_with_proc")
    # One pass over the lines; written, because the table of top processes, the
    # windows and the test for open chains all start from it.
    grouped = materialise(grouped_lines(lines, width, d, keywords, rules=True), "grouped")
    windows = merge_groups(grouped, d, processes, keywords, rules=True)
    windows = _resolve_middles(windows, lines, width, d)
    arms = []
    for i, (name, pattern) in enumerate(d.rules):
        tests = [f"_rule{i}"]
        for j, atoms in enumerate(chains(pattern)):
            tests += [f"coalesce({t}, false)" for t in _chain_hit(i, j, atoms)]
        arms.append((name, " OR ".join(tests)))
    label = _first_of(arms)
    labelled = with_flag(windows.withColumn("window_label", label))
    return labelled.select(*[c for c in labelled.columns if not c.startswith("_")])


def label_distribution(labelled: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent labels with their share of all windows."""
    total = labelled.agg(F.count("*")).scalar()
    return (
        labelled.groupBy("window_label")
        .agg(F.count("*").alias("n"))
        .withColumn("share", F.col("n") / total)
        .orderBy(F.desc("n"), "window_label")
        .limit(top)
    )


def anomaly_rate(labelled: DataFrame) -> DataFrame:
    """``windows, anomalies, rate``."""
    return labelled.agg(
        F.count("*").alias("windows"),
        F.sum(F.col("window_is_anomaly").cast("long")).alias("anomalies"),
        F.avg(F.col("window_is_anomaly").cast("double")).alias("rate"),
    )


def window_anomaly_from_lines(lines: DataFrame, width: str = packs.DEFAULT_WINDOW) -> DataFrame:
    """Flag a bucket if any of its lines carries ``is_anomaly`` (line-level truth)."""
    require(lines, "ts", "is_anomaly")
    keys = [k for k in KEYS if k == "bucket" or k in lines.columns]
    return bucketed(lines, width).groupBy(*keys).agg(
        F.max(F.coalesce(F.col("is_anomaly"), F.lit(0)).cast("int")).alias("window_is_anomaly")
    )
