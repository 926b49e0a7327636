"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``: the fold of a document."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents outside the held-out fold.

    The choice is by a hash of the id, so it is spread evenly and the same on every run.  Null
    labels and ids are left out; an id that is labelled more than once takes its largest label.
    ``limit`` bounds what is broadcast and what the trainer holds; the rest of the fold is not read
    into memory anywhere.
    """
    y = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).dropna()
    chosen = y.where(bucket("id", parts) != held_out).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")
