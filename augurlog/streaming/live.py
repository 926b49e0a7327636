"""Live scoring with Structured Streaming, in three restartable queries.

1. collect:  text files dropped in a folder -> parsed events, appended
2. windows:  events -> closed windows (watermark) with counts and text score
3. alerts:   closed windows -> trends, score, confirmation (state per series)

Each has its own checkpoint, so a restart goes on where it stopped; a batch that is
repeated after a crash counts once in the queries behind it.  Features come from the same expressions as in batch.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from augurlog.functions import packs
from augurlog.functions.dialects import Dialect, dialect as as_dialect
from augurlog.functions.rules import matches
from augurlog.functions.text import example_text
from augurlog.functions.timestamps import general_timestamp, iso_text, syslog_timestamp, width_seconds
from augurlog.operators import tfidf, windows
from augurlog.operators.model import Model, text_logit
from augurlog.operators.trends import expected_inputs
from augurlog.operators.windows import KEYS
from augurlog.sources.parse import with_fields
from augurlog.sources.tables import collected_events

# Workers need not have this package: the state step travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HISTORY = 6
# Folder number and source name of the event that closes a bounded input.
END_BATCH, END_OF_INPUT = -1, "end-of-input"
EVENT_SCHEMA = (
    "ts timestamp, host string, os string, source string, process string, pid string, "
    "message string, raw string, parsed boolean, line_no long, event_key long, batch long, day date"
)
ALERT_SCHEMA = (
    "source_file string, bucket timestamp, early_warning_score double, predict_raw int, "
    "predict_confirmed int, lines long, example_text string"
)
AVAILABLE = {"availableNow": True}
# --- fixed values: flush interval of the collector, default lateness -----------
COLLECT_EVERY = {"processingTime": "5 seconds"}
LATENESS = "1 minute"
# How long a host may send nothing before its state is dropped.
SILENCE = "30 days"


def live_events(
    raw: DataFrame, dialect: str | Dialect, year: int = packs.DEFAULT_YEAR, source: str = "file", clean: bool = False
) -> DataFrame:
    """Raw rows (``value, line_no``) to events.

    Lines that do not parse are kept and stamped with their arrival; so are lines
    with an impossible date.  Only parsed lines are scored later.
    """
    d = as_dialect(dialect)
    rows = raw.select(F.col("value").alias("raw"), "line_no", "event_key")
    own = (
        general_timestamp(F.col("timestamp"))
        if d.timestamp_style == "iso"
        else syslog_timestamp(F.col("timestamp"), year)
    )
    now = F.current_timestamp()
    parsed = (
        with_fields(rows, d)
        .withColumn("arrived", now)
        .withColumn("ts", F.coalesce(own.cast("timestamp"), now))
        .withColumn("parsed", F.col("is_header"))
    )
    events = collected_events(parsed, d.name, source, clean=clean, keep=("parsed", "line_no", "event_key"))
    return events.withColumn("day", F.to_date("ts"))


def start_collector(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    dialect: str | Dialect = "linux",
    year: int = packs.DEFAULT_YEAR,
    source: str = "file",
    fmt: str = "parquet",
    trigger: dict | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Follow a folder of dropped log files; append events by batch and day.

    A repeated batch overwrites its own folder, so the table holds every line once.  To a
    stream that follows the table the rewritten files are new; it tells lines apart by their
    ``event_key`` (file, split and row in the split).
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.text(landing).select("value", F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_path").alias("_file"))

    def write(batch: DataFrame, batch_id: int) -> None:
        events = live_events(numbered_lines(batch), dialect, year, source, clean=fmt == "csv")
        writer = events.write.mode("overwrite").format(fmt).option("header", "true")
        writer.partitionBy("day").save(f"{out}/batch={batch_id}")

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or COLLECT_EVERY))
        .start()
    )


def numbered_lines(batch: DataFrame) -> DataFrame:
    """``value, line_no, event_key`` of raw lines with their ``_file`` and ``_block`` (split start).

    Rows count from the start of their split, whichever splits share a task, so a repeated batch
    gives the same numbers.  ``line_no`` orders lines of one file by place and keeps files apart
    by a hash (12 bits, so that it stays below 10^16).
    """
    rows = batch.select("value", "_file", "_block", F.monotonically_increasing_id().alias("_id"))
    begin = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"))
    placed = rows.join(begin, ["_file", "_block"]).withColumn("_row", F.col("_id") - F.col("_first"))
    slot = F.shiftleft(F.pmod(F.xxhash64("_file"), F.lit(1 << 12)), 40)
    return placed.select("value", (slot + F.col("_block") + F.col("_row")).alias("line_no"), F.xxhash64("_file", "_block", "_row").alias("event_key"))


def _as_lines(events: DataFrame) -> DataFrame:
    """Parsed events as a line table; the host is the series."""
    return events.where("parsed").withColumn("source_file", F.col("host"))


def live_windows(events: DataFrame, model: Model, dialect: str | Dialect, width: str, lateness: str) -> DataFrame:
    """Closed windows of an event stream with the base columns a model needs.

    All aggregates are sums and one set of process names, so a busy window is
    combined on the map side.  Lines of a repeated batch count once.
    """
    d = as_dialect(dialect)
    procs, _ = expected_inputs(model.features)
    counts = [F.count_if(matches("message", p)).alias(k) for k, p in d.keywords.items()]
    counts += [F.count_if(F.col("process") == p).alias(f"cnt_proc_{p}") for p in procs]
    return (
        _as_lines(events)
        .withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["event_key"])
        .groupBy("source_file", F.window("ts", f"{width_seconds(width)} seconds").alias("w"))
        .agg(
            F.count("*").alias("lines"),
            *counts,
            F.size(F.collect_set("process")).cast("long").alias("kw_unique_procs"),
        )
        .select("source_file", F.col("w.start").alias("bucket"), "lines", *[f"`{c}`" for c in _base_columns(d, procs)])
    )


def _base_columns(d: Dialect, procs: list[str]) -> list[str]:
    return [*d.keywords, *[f"cnt_proc_{p}" for p in procs], "kw_unique_procs"]


def _with_text(spark: SparkSession, closed: DataFrame, events_path: str, model: Model, width: str) -> DataFrame:
    """Add text score and first characters of closed windows from their events.

    Only the days of these windows are read, only their lines are kept, and of their terms those of the model counted.
    """
    span = closed.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).first()
    stored = spark.read.schema(EVENT_SCHEMA).parquet(events_path)
    stored = stored.where(
        F.col("day").between(F.to_date(F.lit(span.lo)), F.date_add(F.to_date(F.lit(span.hi)), 1))
        & (F.col("ts") >= F.lit(span.lo))
    )
    keys = closed.select("source_file", F.col("bucket").cast("timestamp_ntz").alias("bucket"))
    lines = windows.bucketed(_as_lines(stored).withColumn("ts", F.col("ts").cast("timestamp_ntz")), width)
    mine = lines.join(keys, KEYS, "left_semi").drop("bucket")
    text = text_logit(tfidf.line_term_counts(mine, width, vocab=model.terms), model.terms)
    heads = windows.window_heads(mine, width)
    named = closed.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    return (
        named.join(text, KEYS, "left")
        .join(heads, KEYS, "left")
        .withColumn("text_logit", F.coalesce("_text_logit", F.lit(0.0)))
        .withColumn("example_text", example_text(F.coalesce("head", F.lit("")), live=True))
        .withColumn("bucket", F.col("bucket").cast("timestamp"))
        .drop("_text_logit", "head")
    )


def start_windows(
    spark: SparkSession,
    events_path: str,
    out: str,
    checkpoint: str,
    model: Model,
    dialect: str | Dialect = "linux",
    width: str = packs.DEFAULT_WINDOW,
    lateness: str = LATENESS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each batch of closed windows to ``out/batch=<id>``.

    A repeated batch overwrites its own folder.  Rows are placed by series, so one
    series is in one file and the next query never sees half of a batch of it.
    """
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(events_path)
    closed = live_windows(stream, model, dialect, width, lateness)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            done = _with_text(batch.sparkSession, batch, events_path, model, width)
            done.repartition("source_file").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        closed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


@dataclass(frozen=True)
class AlertRule:
    """What the alert state needs of a model: plain numbers, small enough to ship."""

    numeric: list[tuple[str, float, float]]
    intercept: float
    threshold: float
    k: int
    min_lines: int
    base: list[str]

    def logit(self, row: dict) -> float:
        return self.intercept + sum(row.get(n, 0.0) * c / s for n, s, c in self.numeric)


def _trend_row(history: list[list[float]], base: list[str]) -> dict:
    """Base values and trends of the newest entry; the same frames as in batch."""
    row = {}
    for i, name in enumerate(base):
        values = [h[i] for h in history]
        row[name] = values[-1]
        row[f"{name}_roll3_mean"] = sum(values[-3:]) / len(values[-3:])
        row[f"{name}_roll6_sum"] = sum(values[-6:])
        row[f"{name}_diff1"] = values[-1] - values[-2] if len(values) > 1 else 0.0
    return row


def alert_state(rule: AlertRule):
    """State step of one series: last six base rows, last k decisions, last window.

    Called with the closed windows of one trigger; there is one small row per window.  Windows
    of a series close in order, so one that isn't after the last was seen before (a repeated
    batch) and is passed over.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, ring, last = state.get if state.exists else ([], [], -1)
        flat, ring = list(flat), list(ring)
        width = max(1, len(rule.base))
        history = [flat[i : i + width] for i in range(0, len(flat), width)] if rule.base else []
        rows = pd.concat(list(frames)).sort_values("bucket")
        out = []
        for r in rows.to_dict("records"):
            at = pd.Timestamp(r["bucket"]).value
            if at <= last:
                continue
            last = at
            history = (history + [[float(r[b]) for b in rule.base]])[-HISTORY:]
            # trends count every window, decisions only those with enough lines
            if r["lines"] < rule.min_lines:
                continue
            values = _trend_row(history, rule.base)
            values["lines"] = float(r["lines"])
            z = rule.logit(values) + r["text_logit"]
            score = 1.0 / (1.0 + math.exp(-z)) if z >= 0 else math.exp(z) / (1.0 + math.exp(z))
            raw = int(score >= rule.threshold)
            ring = (ring + [raw])[-rule.k :]
            confirmed = int(len(ring) == rule.k and sum(ring) == rule.k)
            out.append((key[0], r["bucket"], score, raw, confirmed, int(r["lines"]), r["example_text"]))
        state.update(([v for h in history for v in h], ring, last))
        names = [c.split()[0] for c in ALERT_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names)

    return step


def leaving(step):
    """A state step whose series leaves when the watermark of windows passes its last one.

    The watermark lies the time of silence behind the newest window of any series.  A series that
    comes back later starts anew.  Event time only moves with input, so a run over the available
    input ends.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from step(key, frames, state)
        newest = state.get[2] // 1_000_000
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)

    return run


def start_alerts(
    spark: SparkSession,
    windows_path: str,
    out: str,
    checkpoint: str,
    model: Model,
    threshold: float,
    dialect: str | Dialect = "linux",
    k: int = packs.DEFAULT_K_CONFIRM,
    min_lines: int = packs.DEFAULT_MIN_LINES,
    trigger: dict | None = None,
    silence: str = SILENCE,
) -> StreamingQuery:
    """Score closed windows and confirm alerts; append predictions to ``out``.

    The state of a series without windows for ``silence`` is dropped, so it holds the hosts of that
    time only; windows older than the newest one by more than ``silence`` are not scored.
    """
    d = as_dialect(dialect)
    procs, _ = expected_inputs(model.features)
    base = _base_columns(d, procs)
    schema = (
        "source_file string, bucket timestamp, lines long, "
        + ", ".join(f"`{c}` long" for c in base)
        + ", text_logit double, example_text string"
    )
    rule = AlertRule(model.all_numeric(), model.intercept, threshold, max(1, k), min_lines, base)
    closed = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(windows_path)
    alerts = closed.withWatermark("bucket", silence).groupBy("source_file").applyInPandasWithState(
        leaving(alert_state(rule)),
        ALERT_SCHEMA,
        "history array<double>, ring array<int>, last long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return (
        alerts.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def confirmed_alerts(predictions: DataFrame) -> DataFrame:
    """The alert feed: confirmed rows with a printable line (batch or stream)."""
    line = F.format_string(
        "EARLY WARNING @ %s %s | score=%.3f | lines=%d",
        F.col("source_file"), F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"),
        F.col("early_warning_score"), F.col("lines"),
    )
    return predictions.where("predict_confirmed = 1").withColumn("alert_line", line)


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows the window query dropped as later than the watermark, as far back as its progress goes
    (``late_lines`` has them all)."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for op in progress.get("stateOperators", [])
    )


def prediction_text(predictions: DataFrame) -> DataFrame:
    """Predictions as lines of text, the time in ISO form: what a plain log of predictions holds."""
    score = F.format_string("%.6f", F.col("early_warning_score"))
    return predictions.select(F.concat_ws(",", "source_file", iso_text(F.col("bucket")), score, "predict_raw", "predict_confirmed", "lines").alias("row"))


def late_lines(spark: SparkSession, events_path: str, windows_path: str, width: str) -> DataFrame:
    """``source_file, bucket, lines, late``: per closed window the lines counted, and those that came too late.

    Both are in the tables: every parsed line is an event, and a closed window says how many of
    them it took.  So the count covers all triggers since the start, restarts and repeated batches
    too, where the progress of a query covers its last ones.  A window all of whose lines were late
    has no row among the windows; it shows here with ``lines`` 0.
    """
    events = _as_lines(spark.read.schema(EVENT_SCHEMA).parquet(events_path)).where(F.col("source") != END_OF_INPUT)
    bucket = windows.floor_bucket(F.col("ts"), width).alias("bucket")
    came = events.select("source_file", bucket, "event_key").groupBy("source_file", "bucket").agg(F.count_distinct("event_key").alias("_came"))
    closed = spark.read.option("recursiveFileLookup", "true").schema("source_file string, bucket timestamp, lines long").parquet(windows_path)
    taken = closed.groupBy("source_file", "bucket").agg(F.max("lines").alias("lines"))
    found = came.join(taken, ["source_file", "bucket"], "left").where(F.col("bucket") <= closed.agg(F.max("bucket")).scalar())
    lines = F.coalesce("lines", F.lit(0))
    return found.select("source_file", "bucket", lines.alias("lines"), (F.col("_came") - lines).alias("late"))


def start_live(
    spark: SparkSession,
    landing: str,
    root: str,
    model: Model,
    threshold: float,
    dialect: str | Dialect = "linux",
    width: str = packs.DEFAULT_WINDOW,
    year: int = packs.DEFAULT_YEAR,
    k: int = packs.DEFAULT_K_CONFIRM,
    min_lines: int = packs.DEFAULT_MIN_LINES,
    lateness: str = LATENESS,
) -> list[StreamingQuery]:
    """Start the three queries; tables and checkpoints lie below ``root``."""
    make_folders(spark, f"{root}/events", f"{root}/windows")
    return [
        start_collector(spark, landing, f"{root}/events", f"{root}/_collect", dialect, year),
        start_windows(spark, f"{root}/events", f"{root}/windows", f"{root}/_windows", model, dialect, width, lateness),
        start_alerts(spark, f"{root}/windows", f"{root}/alerts", f"{root}/_alerts", model, threshold, dialect, k, min_lines),
    ]


def run_available(
    spark: SparkSession, landing: str, root: str, model: Model, threshold: float, dialect: str | Dialect = "linux",
    width: str = packs.DEFAULT_WINDOW, year: int = packs.DEFAULT_YEAR, k: int = packs.DEFAULT_K_CONFIRM,
    min_lines: int = packs.DEFAULT_MIN_LINES, lateness: str = LATENESS, final: bool = False,
) -> StreamingQuery:
    """Take in what lies in ``landing`` now, through all three queries, then stop.

    Returns the finished window query.  Calling it again goes on from the checkpoints.  Windows
    that the watermark hasn't passed stay open, unless ``final`` says that the input ends here:
    then they are all closed, and lines that come later are late.
    """
    start_collector(
        spark, landing, f"{root}/events", f"{root}/_collect", dialect, year, trigger=AVAILABLE
    ).awaitTermination()
    make_folders(spark, f"{root}/windows")
    closing = start_windows(
        spark, f"{root}/events", f"{root}/windows", f"{root}/_windows", model, dialect, width, lateness, AVAILABLE
    )
    closing.awaitTermination()
    if final:
        end_of_input(spark, f"{root}/events", width, lateness)
        closing = start_windows(
            spark, f"{root}/events", f"{root}/windows", f"{root}/_windows", model, dialect, width, lateness, AVAILABLE
        )
        closing.awaitTermination()
    start_alerts(
        spark, f"{root}/windows", f"{root}/alerts", f"{root}/_alerts", model, threshold, dialect, k, min_lines, AVAILABLE
    ).awaitTermination()
    return closing


def end_of_input(spark: SparkSession, events_path: str, width: str, lateness: str) -> None:
    """Add one event so late that the watermark passes all windows; its own window stays open."""
    stored = spark.read.schema(EVENT_SCHEMA).parquet(events_path).where("parsed")
    after = F.expr(f"INTERVAL {lateness}") + F.expr(f"INTERVAL {2 * width_seconds(width)} SECONDS")
    mark = stored.agg(F.max("ts").alias("ts")).where("ts is not null").select(
        (F.col("ts") + after).alias("ts"), F.lit("").alias("host"), F.lit(END_OF_INPUT).alias("os"), F.lit(END_OF_INPUT).alias("source"),
        F.lit("").alias("process"), F.lit("").alias("pid"), F.lit("").alias("message"), F.lit("").alias("raw"), F.lit(True).alias("parsed"),
        F.lit(0).cast("long").alias("line_no"), F.xxhash64(F.lit(END_OF_INPUT), "ts").alias("event_key"),
    ).withColumn("day", F.to_date("ts"))
    mark.coalesce(1).write.mode("overwrite").partitionBy("day").parquet(f"{events_path}/batch={END_BATCH}")


def make_folders(spark: SparkSession, *paths: str) -> None:
    """Create folders on whatever file system a path names; a stream source must exist."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
