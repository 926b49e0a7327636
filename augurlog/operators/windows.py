"""Lines to time windows.

A line table has ``source_file, line_no, ts, process, message``; a window is one
non-empty bucket of one source file.  All features of a window are sums, counts,
minima or maxima, computed in two aggregations: per (source_file, bucket,
process), then per (source_file, bucket).  Both combine on the map side, the
message text is never shuffled, and a bucket that holds a third of all lines is
only a few partial rows by the time it reaches one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.functions.dialects import Dialect, dialect as as_dialect
from augurlog.functions.rules import chains, match_sql
from augurlog.functions.text import blank_if_null, line_text
from augurlog.functions.timestamps import epoch_micros, floor_bucket, width_seconds

KEYS = ["source_file", "bucket"]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail while the plan is built if a column is missing; name what is there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df


def bucketed(lines: DataFrame, width: str = packs.DEFAULT_WINDOW) -> DataFrame:
    """Drop lines without time, add ``bucket``; absent text fields become ``""``."""
    require(lines, "ts")
    text = lambda c: blank_if_null(F.col(c)) if c in lines.columns else F.lit("")
    return (
        lines.where(F.col("ts").isNotNull())
        .withColumn("bucket", floor_bucket(F.col("ts"), width))
        .withColumn("process", text("process"))
        .withColumn("message", text("message"))
    )


# One number that orders lines by (time, line number).
LINE_POSITION = (
    "CAST(CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DECIMAL(19, 0)) * CAST(10000000000000000 AS DECIMAL(17, 0))"
    " + CAST(line_no AS DECIMAL(17, 0)) AS DECIMAL(38, 0))"
)


def keyword_counts(d: Dialect) -> list[Column]:
    """Per keyword: how many messages match it (once per line)."""
    return [
        F.expr(f"count_if({match_sql('message', p, '_low_message')})").alias(k) for k, p in d.keywords.items()
    ]


def rule_aggregates(d: Dialect) -> dict[str, tuple[str, str]]:
    """What decides every rule for a window: name -> (merging function, SQL over lines)."""
    match = lambda pattern: match_sql("_line", pattern, "_low_line")
    out = {}
    for i, (_, pattern) in enumerate(d.rules):
        out[f"_rule{i}"] = ("max", match(pattern))
        for j, atoms in enumerate(chains(pattern)):
            if len(atoms) > 1:
                for name, part, fn in _chain_parts(i, j, atoms):
                    out[name] = (fn, f"CASE WHEN {match(part)} THEN {LINE_POSITION} END")
    return out


def _chain_parts(i: int, j: int, atoms: list[str]):
    """(alias, pattern, aggregate) needed to follow one chain across lines."""
    tag = f"_r{i}_{j}"
    yield f"{tag}_a_min", atoms[0], "min"
    yield f"{tag}_z_max", atoms[-1], "max"
    if len(atoms) == 3:
        yield f"{tag}_ab_min", ".*".join(atoms[:2]), "min"
        yield f"{tag}_bz_max", ".*".join(atoms[1:]), "max"
        yield f"{tag}_b_min", atoms[1], "min"
        yield f"{tag}_b_max", atoms[1], "max"


def grouped_lines(
    lines: DataFrame, width: str, d: Dialect, keywords: bool = True, rules: bool = False
) -> DataFrame:
    """First aggregation: one row per (source_file, bucket, process)."""
    aggs = [F.count("*").alias("_n")]
    if keywords:
        aggs += keyword_counts(d)
    cut = bucketed(lines, width)
    if keywords:
        cut = cut.withColumn("_low_message", F.lower("message"))
    if rules:
        aggs += [F.expr(f"{fn}({sql})").alias(name) for name, (fn, sql) in rule_aggregates(d).items()]
        cut = cut.withColumn("_line", line_text(F.col("process"), F.col("message")))
        cut = cut.withColumn("_low_line", F.lower("_line"))
    return cut.groupBy(*KEYS, "process").agg(*aggs)


def top_processes(grouped: DataFrame, n: int = packs.TOP_PROCESSES) -> DataFrame:
    """The ``n`` most frequent processes of each source file: ``source_file, process, total, rank``.

    A blank name can take one of the places, as in a plain frequency table; ties
    go to the smaller name.
    """
    ranked = Window.partitionBy("source_file").orderBy(F.desc("total"), F.asc("process"))
    return (
        grouped.groupBy("source_file", "process")
        .agg(F.sum("_n").alias("total"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= n)
    )


def create_windows(
    lines: DataFrame,
    width: str = packs.DEFAULT_WINDOW,
    dialect: str | Dialect = "linux",
    processes: list[str] | DataFrame | None = None,
    keywords: bool = True,
    rules: bool = False,
) -> DataFrame:
    """One row per non-empty bucket of each source file.

    Columns: ``source_file, bucket, lines, proc_counts, kw_*, kw_unique_procs``
    (and hidden rule columns for ``labels``).  ``proc_counts`` is a map with an
    entry for each of the file's top processes seen in the bucket; with
    ``processes`` (what a model was fitted with: a list, or a table ``process`` of
    any length) it covers these instead.
    """
    d = as_dialect(dialect)
    return merge_groups(grouped_lines(lines, width, d, keywords, rules), d, processes, keywords, rules)


def merge_groups(
    grouped: DataFrame, d: Dialect, processes: list[str] | DataFrame | None = None, keywords: bool = True, rules: bool = False
) -> DataFrame:
    """Second aggregation: the per-process rows of a bucket become its window."""
    entry = F.struct("process", "_n")
    if processes is None:
        top = top_processes(grouped).where(F.col("process") != "").select("source_file", "process", F.lit(True).alias("_top"))
        grouped = grouped.join(top, ["source_file", "process"], "left")
        kept = F.when(F.col("_top"), entry)
    elif isinstance(processes, DataFrame):
        wanted = processes.where(F.col("process") != "").select("process", F.lit(True).alias("_wanted")).distinct()
        grouped = grouped.join(wanted, "process", "left")
        kept = F.when(F.col("_wanted"), entry)
    else:
        kept = F.when(F.col("process").isin([p for p in processes if p]), entry)
    aggs = [
        F.sum("_n").alias("lines"),
        # at most as many entries as there are kept processes
        F.map_from_entries(F.collect_list(kept)).alias("proc_counts"),
    ]
    if keywords:
        aggs += [F.expr(f"sum({k})").alias(k) for k in d.keywords]
        aggs.append(F.count("*").alias("kw_unique_procs"))
    if rules:
        aggs += [F.expr(f"{fn}({name})").alias(name) for name, (fn, _) in rule_aggregates(d).items()]
    return grouped.groupBy(*KEYS).agg(*aggs)


def process_vocabulary(windows: DataFrame) -> DataFrame:
    """``process``: the names of all processes that have counts."""
    return windows.select(F.explode(F.map_keys("proc_counts")).alias("process")).distinct()


def widen_processes(windows: DataFrame, processes: list[str]) -> DataFrame:
    """``cnt_proc_*`` columns (0 where absent) in place of the map, for a list short enough to be a
    schema.  The model takes the counts in long form instead (``trends.process_features``)."""
    counts = [
        F.coalesce(F.col("proc_counts")[F.lit(p)], F.lit(0).cast("long")).alias(f"cnt_proc_{p}")
        for p in processes
    ]
    fixed = [c for c in windows.columns if c in (*KEYS, "lines")]
    rest = [c for c in windows.columns if c not in (*fixed, "proc_counts")]
    return windows.select(*fixed, *counts, *[F.col(f"`{c}`") for c in rest])


def process_counts_long(lines: DataFrame, width: str = packs.DEFAULT_WINDOW) -> DataFrame:
    """All process counts in long form; no limit on the number of processes."""
    return bucketed(lines, width).groupBy(*KEYS, "process").agg(F.count("*").alias("n"))


def window_text(lines: DataFrame, width: str = packs.DEFAULT_WINDOW, slices: int = 64) -> DataFrame:
    """Joined text of each window: ``text`` and ``text_with_proc``.

    One window is one string here, so a window's text must fit a string (2 GB).
    Features, labels and the model do not need it; use it to look at windows.
    The lines are joined per slice of the window first, so the sort of a large
    window is spread over ``slices`` groups.
    """
    step = max(1, width_seconds(width) * 1_000_000 // slices)
    cut = bucketed(lines, width).withColumn("_slice", F.floor(epoch_micros(F.col("ts")) / F.lit(step)))
    order = F.struct("ts", "line_no")
    item = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ts", "line_no", c.alias("v")))), lambda s: s["v"])
    sep = packs.TEXT_SEPARATOR
    parts = cut.groupBy(*KEYS, "_slice").agg(
        F.count("*").alias("_n"),
        F.array_join(item(F.col("message")), sep).alias("_text"),
        F.array_join(item(line_text(F.col("process"), F.col("message"))), sep).alias("_with"),
    )
    joined = lambda c: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_slice", c))), lambda s: s[c]), sep
    )
    return parts.groupBy(*KEYS).agg(
        F.sum("_n").alias("lines"), joined("_text").alias("text"), joined("_with").alias("text_with_proc")
    )


def window_heads(lines: DataFrame, width: str = packs.DEFAULT_WINDOW, slices: int = 64) -> DataFrame:
    """The first ``EXAMPLE_CHARS`` characters of each window's text, as ``head``.

    Every line adds at least two characters, so the first ``EXAMPLE_CHARS`` lines by
    time are always enough.  They are picked per slice of the window, then per
    window; both limits also apply on the map side.
    """
    n = packs.EXAMPLE_CHARS
    step = max(1, width_seconds(width) * 1_000_000 // slices)
    rank = lambda *extra: F.row_number().over(Window.partitionBy(*KEYS, *extra).orderBy("ts", "line_no"))
    text = line_text(F.col("process"), F.col("message"))
    first = (
        bucketed(lines, width)
        .select(
            *KEYS, "ts", "line_no", F.substring(text, 1, n).alias("v"),
            F.floor(epoch_micros(F.col("ts")) / F.lit(step)).alias("_slice"),
        )
        .withColumn("_in_slice", rank("_slice"))
        .where(F.col("_in_slice") <= n)
        .withColumn("_rank", rank())
        .where(F.col("_rank") <= n)
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "v"))), lambda s: s["v"])
    return first.groupBy(*KEYS).agg(
        F.substring(F.array_join(items, packs.TEXT_SEPARATOR), 1, n).alias("head")
    )


def keep_min_lines(windows: DataFrame, min_lines: int = packs.DEFAULT_MIN_LINES) -> DataFrame:
    """Keep windows with enough lines; 0 turns the filter off."""
    if min_lines <= 0 or "lines" not in windows.columns:
        return windows
    return windows.where(F.coalesce(F.col("lines"), F.lit(0)) >= min_lines)


def keyword_totals(windows: DataFrame) -> DataFrame:
    """``keyword, total`` over all windows."""
    names = [c for c in windows.columns if c.startswith("kw_") and not c.endswith(("_mean", "_sum", "_diff1"))]
    sums = windows.agg(*[F.sum(c).alias(c) for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("keyword"), F.col(c).alias("total")) for c in names]))
    return sums.select(pairs.alias("p")).select("p.keyword", "p.total")
