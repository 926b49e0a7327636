"""Reading the given tables, written intermediates, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from augurlog.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _written_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and a count and checksum taken while writing."""
    seen = Observation()
    stored = materialise(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "edges")
    return stored, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (u, v): root is the smallest node that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond").  Each step moves every edge once, keyed by its node, and takes only
    minima, so a node with very many neighbours is pre-aggregated; each round is a written table.
    Edges with a null end and loops are left out.
    """
    written, before = _written_edges(edges.select("u", "v").where("u <> v").distinct()), None
    while written[1] != before:
        edges, before = written
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        down = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        written = _written_edges(small.where("u <> v").distinct())
    edges = written[0]
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
