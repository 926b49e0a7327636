"""Raw text to fields, as expressions for batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.functions.dialects import Dialect
from augurlog.functions.timestamps import general_timestamp, syslog_timestamp
from augurlog.session import broadcast_if_small, materialise

# "d": "." crosses everything but a line feed; "U": Unicode digits, words, blanks
LINE_FLAGS = "(?Ud)"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def header_fields(raw: Column, d: Dialect) -> Column:
    """All groups of the line pattern as one array; a one-element array if none match.

    One regex pass per line: a match is rewritten to its groups with line feeds
    between them and split there (a line holds no line feed, so this is exact).
    """
    groups = 4 if d.carry_forward else 5
    rewritten = F.regexp_replace(raw, LINE_FLAGS + d.line_pattern, "\n".join(f"${i + 1}" for i in range(groups)))
    return F.split(rewritten, "\n", groups)


def with_fields(rows: DataFrame, d: Dialect) -> DataFrame:
    """Add ``is_header`` and the fields to a table with ``raw``.

    Every field is ``""`` when the line does not parse (carry-forward dialects keep
    the line as message); an absent pid is ``""``.
    """
    cut = rows.withColumn("_f", header_fields(F.col("raw"), d))
    ok = F.coalesce(F.size("_f") > 1, F.lit(False))
    part = lambda i: F.when(ok, F.col("_f")[i]).otherwise(F.lit(""))
    if d.carry_forward:
        fields = {
            "timestamp": strip(part(0)),
            "host": F.lit(d.fixed_host),
            "process": strip(part(2)),
            "pid": F.lit(""),
            "message": strip(F.when(ok, F.col("_f")[3]).otherwise(F.col("raw"))),
        }
    else:
        names = ("timestamp", "host", "process", "pid", "message")
        fields = {name: part(i) for i, name in enumerate(names)}
    return cut.withColumns({"is_header": ok, **fields}).drop("_f")


def parse_lines(raw_lines: DataFrame, d: Dialect) -> DataFrame:
    """Fields of a numbered line table; ``is_header`` marks lines that parsed.

    For carry-forward dialects blank lines are left out (they keep their number)
    and time and process are still empty on continuation lines.
    """
    rows = raw_lines.where(F.col("raw") != "") if d.carry_forward else raw_lines
    return with_fields(rows, d)


def carry_forward(
    parsed: DataFrame, series: str = "source_file", order: str = "line_no", block: int = 1 << 16
) -> DataFrame:
    """Continuation lines take time and process of the last header before them.

    ``order`` is a whole line number.  Lines are carried inside blocks of ``block``
    numbers; the last header of each block (one narrow row per block) is walked in
    order and handed to the blocks after it, so a long file is many small groups.
    """
    head = F.when(F.col("is_header"), F.struct("timestamp", "process"))
    blocked = parsed.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    lasts = blocked.groupBy(series, "_block").agg(
        F.max_by(head, F.when(F.col("is_header"), F.col(order))).alias("_last")
    )
    before = Window.partitionBy(series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(series, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(series, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(carried, [series, "_block"])
        .withColumn("_head", F.coalesce(F.last(head, ignorenulls=True).over(inside), F.col("_carried")))
        .withColumn("timestamp", F.coalesce(F.col("_head.timestamp"), F.lit("")))
        .withColumn("process", F.coalesce(F.col("_head.process"), F.lit("")))
        .drop("_head", "_block", "_carried")
    )


def gated_timestamp(general: Column, text: Column, repair: Column, d: Dialect, year: int) -> Column:
    """General parse; where ``repair`` holds, failures are parsed under ``year``."""
    if d.timestamp_style == "iso":
        return general
    return F.when(repair, F.coalesce(general, syslog_timestamp(text, year))).otherwise(general)


def parse_timestamps(
    lines: DataFrame,
    d: Dialect,
    year: int = packs.DEFAULT_YEAR,
    gate: float = packs.FALLBACK_GATE,
    series: str = "source_file",
) -> DataFrame:
    """Add ``ts``.  Syslog stamps carry no year: a file is read under ``year`` when
    more than ``gate`` of its stamps fail the general parse, else those stay null.

    The share per file is one narrow row per file, found first and joined back.
    """
    if d.timestamp_style == "iso":
        return lines.withColumn("ts", general_timestamp(F.col("timestamp")))
    staged = lines.withColumn("_general", general_timestamp(F.col("timestamp")))
    share = staged.groupBy(series).agg(
        (F.avg(F.col("_general").isNull().cast("double")) > gate).alias("_repair")
    )
    return (
        staged.join(broadcast_if_small(materialise(share, "stamps")), series)
        .withColumn("ts", gated_timestamp(F.col("_general"), F.col("timestamp"), F.col("_repair"), d, year))
        .drop("_general", "_repair")
    )


def dropped_lines(lines: DataFrame) -> DataFrame:
    """``lines, without_time``: how many lines windowing will leave out."""
    return lines.agg(
        F.count("*").alias("lines"), F.count_if(F.col("ts").isNull()).alias("without_time")
    )
