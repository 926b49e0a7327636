"""Stage tables: read, write, union, and the collected-event form."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from augurlog.functions.text import sanitise
from augurlog.session import broadcast_if_small, materialise

# Rows per file of a chunked write.
CHUNK_ROWS = 500_000


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a stage table.  CSV needs a schema: types are never inferred from text."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        raise ValueError("a CSV stage table needs a schema")
    if fmt == "csv":
        reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.load(path)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
    chunk_rows: int = CHUNK_ROWS,
    mode: str = "overwrite",
) -> int:
    """Write a stage table in files of at most ``chunk_rows`` rows; returns rows written.

    With ``partition_by`` a folder gets as many files as its rows need, whatever tasks they come from.
    """
    if partition_by:
        df = dealt(df, partition_by, chunk_rows)
    seen = Observation()
    writer = (
        df.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode(mode)
        .format(fmt)
        .option("maxRecordsPerFile", chunk_rows)
    )
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return seen.get["rows"]


def dealt(df: DataFrame, keys: tuple[str, ...], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows, dealt to tasks so that a folder per value of ``keys`` holds files of about ``chunk_rows`` rows.

    Written as they come, the rows of a folder would be spread over all tasks, one small file each.
    A value with many rows gets one slot per ``chunk_rows`` of them; a slot is in one task.
    """
    spark = df.sparkSession
    df = materialise(df, "dealt")
    slots = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("_slots"))
    slots = materialise(slots.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_slots"), "slots")
    total = slots.agg(F.sum("_slots")).first()[0] or 1
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    placed = df.withColumn("_row", F.monotonically_increasing_id()).join(broadcast_if_small(slots), same)
    placed = placed.withColumn("_slot", F.pmod("_row", "_slots"))
    tasks = min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // chunk_rows)))
    return placed.repartition(tasks, *keys, "_slot").select(*[F.col(f"`{c}`") for c in df.columns])


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables by column name; a column one table lacks is null there."""
    if not tables:
        raise ValueError("no tables to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """One table from all stage files of a folder, with ``source_file`` as provenance.

    A ``source_file`` that the files hold stays; else it is the file's path below ``path``, so
    equal names in two folders differ.
    """
    df = (
        spark.read.option("mergeSchema", "true")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )
    if "source_file" in df.columns:
        return df
    root = re.escape(re.sub(r"^[a-z]+:/*", "/", path.rstrip("/")))
    below = F.regexp_replace(F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/"), f"^{root}/", "")
    return df.withColumn("source_file", below)


def collected_events(
    parsed: DataFrame, os_name: str, source: str, arrived: str = "arrived", clean: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The collected form of live lines: ``ts, host, os, source, process, pid, message, raw``.

    A line that does not parse is kept as a raw-only event stamped with its arrival.
    ``clean`` takes line breaks and commas out, as a CSV sink needs; ``keep`` names
    columns to carry along.
    """
    ok = F.col("is_header")
    tidy = sanitise if clean else (lambda c: c)
    text = lambda c: tidy(F.when(ok, F.col(c)).otherwise(F.lit("")))
    bare = F.trim(F.col("raw"))
    return parsed.select(
        F.coalesce(F.when(ok, F.col("ts")), F.col(arrived)).alias("ts"),
        text("host").alias("host"),
        F.lit(os_name).alias("os"),
        F.lit(source).alias("source"),
        text("process").alias("process"),
        text("pid").alias("pid"),
        tidy(F.when(ok, F.col("message")).otherwise(bare)).alias("message"),
        tidy(F.when(ok, F.col("raw")).otherwise(bare)).alias("raw"),
        *keep,
    )
