"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from augurlog.llm import decontaminate, mixing, near_dedup, pii, quality_crf
from augurlog.llm.tables import table
from augurlog.llm.textcore import unused
from augurlog.session import materialise

#: Key of the surrogates; give your own in production.
PII_KEY = "corpus pipeline"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects go."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; a link is a Jaccard similarity of 0.8 or more.

    Three rows a key give 12 x 12 tables at this similarity; four would give 16 x 16.
    """
    return near_dedup.keep_one(docs, percent=80, rows=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, personal data in their texts is replaced; n_chars counts the new text."""
    count = unused("n_entities", docs.columns)
    replaced = pii.pseudonymised(docs, PII_KEY, count=count)
    if "n_chars" in docs.columns:
        changed = f"IF({count} > 0, CAST(length(text) AS {docs.schema['n_chars'].dataType.simpleString()}), n_chars)"
        return replaced.selectExpr(*[f"{changed} AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])
    return replaced.select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words taken; ``finish`` tells the order of the mix, the rows come in any."""
    taken = unused("taken", docs.columns)
    return mixing.mix(docs, docs.columns).where(f"`{taken}` > 0")


STAGES = [
    ("quality_crf", quality_stage), ("minhash_near_dedup", near_dedup_stage), ("suffix_array_decontamination", decontamination_stage),
    ("pii_surrogates", pii_stage), ("weighted_fair_mix", mixing_stage),
]

#: Model training and iterative grouping are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
