"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurlog.llm import (
    bit_mixing, bpe_automaton, chunk_dedup, decontaminate, hard_negatives, mixing, near_dedup, pii, quality_crf, simhash, spelling, toxicity, url_filter,
)
from augurlog.llm.tables import table


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced; the key is a parameter of the operator."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key="op1").select("doc_id", "text", "n_entities")


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near, the documents near in fingerprint, is given for the ids divisible by 100."""
    return simhash.with_neighbours(simhash.with_next(table(spark, sf_dir, "documents")))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(table(spark, sf_dir, "pages"), rules)


def op6_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op7_logistic_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_mixing.scored(table(spark, sf_dir, "documents"))


def op8_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op9_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.deduplicated(table(spark, sf_dir, "documents"), ["doc_id"])


def op11_bit_sliced_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = bpe_automaton.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    texts = bpe_automaton.decoded(ids, path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return texts.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_lemp_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("id"), F.col("label")
    return hard_negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), anchor=vec_id % 50 == 0, relabel=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label),
    )


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
