"""Log files to line tables.

Spark reads a large file in splits, by many tasks at once, so a line does not know
its number, nor the header before its split.  Both are found in two steps: the text
is parsed and written once, with each line's place (split, row in the split's task);
then one narrow row per split (its line count, its last header) is walked in file
order and joined back.  No file is ever handled as a whole by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.functions.dialects import Dialect, dialect as as_dialect
from augurlog.functions.timestamps import general_timestamp
from augurlog.session import broadcast_if_small, materialise
from augurlog.sources.parse import gated_timestamp, parse_timestamps, with_fields

LINE_COLUMNS = ["line_no", "timestamp", "host", "process", "pid", "message", "raw"]
ERRORS = ("replace", "strict", "ignore")
_ROW_BITS = 33


def decoded(raw: Column, encoding: str = "utf-8", errors: str = "replace") -> Column:
    """Bytes of a line to text.  UTF-8 follows ``errors``; other single-byte
    charsets are decoded as named."""
    if errors not in ERRORS:
        raise ValueError(f"errors must be one of {ERRORS}")
    name = encoding.lower().replace("_", "-")
    if name in ("utf-8", "utf8", "utf-8-sig"):
        if errors == "strict":
            return F.validate_utf8(raw)
        valid = F.make_valid_utf8(raw)
        if errors == "ignore":
            return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(valid, F.lit("�"), F.lit("")))
        return valid
    if name.startswith(("utf-16", "utf-32")):
        raise ValueError(f"{encoding}: line breaks are not single bytes; convert the files first")
    return F.decode(raw.cast("binary"), encoding)


def read_raw(
    spark: SparkSession,
    path: str | list[str],
    recursive: bool = False,
    pattern: str = "*.log",
    encoding: str = "utf-8",
    errors: str = "replace",
) -> DataFrame:
    """``source_file, raw`` and each line's place (``_block, _row``).

    ``path`` is one file, or a folder whose ``*.log`` files are read (with
    ``recursive`` also those of its subfolders).
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    paths = [path] if isinstance(path, str) else list(path)
    if not all(p.endswith(pattern.lstrip("*")) for p in paths):
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"),
        decoded(F.col("value"), encoding, errors).alias("raw"),
        F.col("_metadata.file_block_start").alias("_block"),
        # place of the row in its task; increasing inside a split
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )


def _splits(placed: DataFrame, d: Dialect) -> DataFrame:
    """One row per split: first row, lines before it in the file, header carried in,
    and whether the file's stamps need the caller's year."""
    head = F.when(F.col("is_header"), F.struct("timestamp", "process"))
    per_split = placed.groupBy("source_file", "_block").agg(
        F.min("_row").alias("_first"),
        F.count("*").alias("_lines"),
        F.max_by(head, F.when(F.col("is_header"), F.col("_row"))).alias("_last_head"),
        F.count_if(general_timestamp(F.col("timestamp")).isNull()).alias("_failed"),
    )
    # a file has one row per split here (its size over the split size)
    before = (
        Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("source_file")
    return per_split.select(
        "source_file",
        "_block",
        "_first",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"),
        F.last("_last_head", ignorenulls=True).over(before).alias("_carried"),
        (F.sum("_failed").over(whole) / F.sum("_lines").over(whole) > packs.FALLBACK_GATE).alias("_repair"),
    )


def _carry_in_split(numbered: DataFrame) -> DataFrame:
    """Headers carried forward split by split; a split's start takes what came in."""
    inside = (
        Window.partitionBy("source_file", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    )
    head = F.when(F.col("is_header"), F.struct("timestamp", "process"))
    seen = F.coalesce(F.last(head, ignorenulls=True).over(inside), F.col("_carried"))
    return (
        numbered.withColumn("_head", seen)
        .withColumn("timestamp", F.coalesce(F.col("_head.timestamp"), F.lit("")))
        .withColumn("process", F.coalesce(F.col("_head.process"), F.lit("")))
        .drop("_head")
    )


def read_logs(
    spark: SparkSession,
    path: str | list[str],
    dialect: str | Dialect = "linux",
    year: int = packs.DEFAULT_YEAR,
    recursive: bool = False,
    pattern: str = "*.log",
    encoding: str = "utf-8",
    errors: str = "replace",
) -> DataFrame:
    """Parsed lines of log files: ``source_file, os`` + ``LINE_COLUMNS`` + ``ts``.

    Lines that do not parse are kept with ``raw`` only; their ``ts`` is null.
    """
    d = as_dialect(dialect)
    raw = read_raw(spark, path, recursive, pattern, encoding=encoding, errors=errors)
    # Blank lines of carry-forward dialects count for numbering, so they are
    # dropped after the lines have their numbers.
    fields = with_fields(raw.withColumn("_blank", F.col("raw") == ""), d)
    placed = materialise(fields, "lines")
    splits = broadcast_if_small(materialise(_splits(placed, d), "splits"))
    numbered = placed.join(splits, ["source_file", "_block"]).withColumn(
        "line_no", F.col("_row") - F.col("_first") + F.col("_before") + 1
    )
    if d.carry_forward:
        numbered = _carry_in_split(numbered).where(~F.col("_blank"))
    general = general_timestamp(F.col("timestamp"))
    ts = gated_timestamp(general, F.col("timestamp"), F.col("_repair"), d, year)
    return numbered.withColumn("ts", ts).select("source_file", F.lit(d.name).alias("os"), *LINE_COLUMNS, "ts")



def read_parsed(spark: SparkSession, path: str | list[str], dialect: str | Dialect = "linux", year: int = packs.DEFAULT_YEAR) -> DataFrame:
    """Lines that were parsed before, from ``.csv`` files with the columns ``LINE_COLUMNS``: as ``read_logs`` gives them.

    Quoted fields may hold line breaks.  Columns are read by name; one that a file lacks is empty.
    """
    d = as_dialect(dialect)
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("enforceSchema", "false")
    raw = reader.csv(path if isinstance(path, list) else [path])
    column = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in raw.columns else F.lit("")
    lines = raw.select(
        F.col("_metadata.file_path").alias("source_file"), F.lit(d.name).alias("os"), column("line_no").try_cast("long").alias("line_no"), *[column(c).alias(c) for c in LINE_COLUMNS[1:]]
    )
    return parse_timestamps(materialise(lines, "parsed-lines"), d, year).select("source_file", "os", *LINE_COLUMNS, "ts")
