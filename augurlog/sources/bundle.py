"""A saved model: coefficient tables, thresholds, metrics, validation scores.

    <path>/terms        term, idf, idx, coef
    <path>/numeric      pos, feature, scale, coef
    <path>/numbers      feature, idx, scale, coef of inputs in long form, if the model has them
    <path>/processes    process, if the model was fitted with a list of them
    <path>/info         one JSON row: intercept, text column, metadata, which tables there are
    <path>/thresholds   one JSON row per choice; the latest one counts
    <path>/val_scores, <path>/metrics_*, <path>/calibration
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurlog.operators.model import Model

_THRESHOLDS = "threshold double, policy string, details string, created_at timestamp"


def save_model(model: Model, path: str) -> None:
    spark = model.terms.sparkSession
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    rows = [(i, n, s, c) for i, (n, s, c) in enumerate(model.numeric)]
    schema = "pos int, feature string, scale double, coef double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/numeric")
    tables = {"numbers": model.numbers, "processes": model.processes}
    for name, table in tables.items():
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    info = json.dumps(
        {
            "intercept": model.intercept,
            "text_col": model.text_col,
            "tables": [name for name, table in tables.items() if table is not None],
            "meta": model.meta,
        }
    )
    spark.createDataFrame([(info,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> Model:
    info = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/info").collect()))
    numeric = spark.read.parquet(f"{path}/numeric").orderBy("pos").collect()
    optional = lambda name: spark.read.parquet(f"{path}/{name}") if name in info["tables"] else None
    return Model(
        numbers=optional("numbers"),
        terms=spark.read.parquet(f"{path}/terms"),
        numeric=[(r.feature, r.scale, r.coef) for r in numeric],
        intercept=info["intercept"],
        text_col=info["text_col"],
        processes=optional("processes"),
        meta=info["meta"],
    )


def add_threshold(spark: SparkSession, path: str, threshold: float, policy: str, **details) -> None:
    """Record a threshold choice (training or calibration).  Scoring takes the latest."""
    now = datetime.now(timezone.utc)
    row = [(float(threshold), policy, json.dumps(details), now)]
    spark.createDataFrame(row, _THRESHOLDS).coalesce(1).write.mode("append").json(f"{path}/thresholds")


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_THRESHOLDS).json(f"{path}/thresholds")


def load_threshold(spark: SparkSession, path: str) -> float:
    """The latest threshold of a bundle; an error if there is none."""
    try:
        row = thresholds(spark, path).orderBy(F.desc("created_at")).select("threshold").first()
    except AnalysisException:
        row = None
    if row is None:
        raise FileNotFoundError(f"no threshold in {path}")
    return row.threshold


def save_table(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}")
