"""Session settings, durable scratch tables and the broadcast size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound, in rows, for a narrow table (a few short columns) that may be
# broadcast.  About 100 bytes a row keeps the hash table near 100 MB.
BROADCAST_ROWS = 1_000_000

_scratch_root: dict[str, str] = {}


def get_session(app: str = "augurlog", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine relies on (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    On a cluster this is the folder named in ``spark.checkpoint.dir``, which all
    executors must share.  Only a local master, whose tasks all run on this machine,
    may do without: there a temporary folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.lower().startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _scratch_root:
        _scratch_root[app] = tempfile.mkdtemp(prefix="augurlog-")
    return _scratch_root[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root."""
    return f"{scratch_root(spark)}/augurlog-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by a written table, so later steps survive executor loss
    without recomputing the whole chain."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``max_rows`` rows.

    Call it on written tables, where counting reads no column; each task sends one number.
    """
    return df.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; beyond it a shuffled join is planned."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input of few splits over all cores before per-row work.

    A small table in one file is read by one task.  Inputs with at least as many
    partitions as cores - any large table - are left alone.  For plain scans only:
    the check plans ``df``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
