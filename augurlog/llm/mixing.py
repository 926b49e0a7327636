"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow of its documents in a fixed shuffled order (by a hash of the id), gone
through twice at most.  A document's virtual finish time is the running number of words of its
flow, itself included, divided by the flow's target; served in this order all flows progress in
proportion to their targets.  The order is cut where the total budget is used up.

Nothing is sorted or summed in one task: running sums come from blocks of the hash plus block
totals, so a source that holds most rows is spread over all blocks.  Finish times and sizes, without
ids and texts, are range-sorted over all partitions and truncated at the budget; the documents
themselves are not moved, but taken by the time at which the order was cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from augurlog.llm.textcore import unused
from augurlog.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Rows of one block of a source, on average at most.
BLOCK_ROWS = 10_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its place (from 0) in the order of ``column``, nulls last, without a one-task sort.

    Partitions are ranges; their row counts, one per partition, shift the places within them.
    """
    order = F.col(column).asc_nulls_last()
    ranged = materialise(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_id", 33)
    shift, total = [], 0
    for row in sorted(ranged.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect()):
        shift.append((row.p, total))
        total += row.c
    shifts = df.sparkSession.createDataFrame(shift, "p long, shift long")
    return ranged.withColumn("p", part).join(F.broadcast(shifts), "p").withColumn("place", F.col("shift") + F.expr("_id & 8589934591")).drop("p", "shift", "_id")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, float]:
    """(source, source_size, target) from (source, source_size), and the budget.

    Sources in code point order, null last, have ``weights`` in turn and divide ``share`` of all
    words; a target stops at ``repeats`` times its source, and what is above goes to the others by
    weight, until none is above.
    """
    cycle = "array(" + ", ".join(map(str, weights)) + ")"
    flows = materialise(numbered(sizes, "source").withColumn("weight", F.expr(f"element_at({cycle}, CAST(place % {len(weights)} AS INT) + 1)")), "flows")
    budget = share * (flows.agg(F.sum("source_size")).first()[0] or 0)
    full = f"source_size * {repeats}"
    level, before = 0.0, None
    while before is None or level > before:
        # Sources that the level fills keep their full size; the rest share what is left.
        x = flows.agg(
            F.sum(F.expr(f"IF({full} < {level!r}D * weight, {full}, 0)")).alias("filled"),
            F.sum(F.expr(f"IF({full} < {level!r}D * weight, 0, weight)")).alias("open"),
        ).first()
        before = level if before is not None else -1.0
        if not x.open:
            break
        level = max(level, (budget - x.filled) / x.open)
    return flows.selectExpr("source", "source_size", f"least(CAST({full} AS DOUBLE), {level!r}D * weight) AS target"), budget


def _sized(docs: DataFrame, keep: list[str], doc_id: str, source: str, text: str) -> DataFrame:
    """A struct of the kept columns, source, size, and the shuffled place of every row."""
    place = F.struct(F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")).alias("h"), F.xxhash64(f"`{text}`").alias("tie"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), place.alias("at"))


def _timed(sized: DataFrame, flows: DataFrame, before: DataFrame, digits: int) -> DataFrame:
    """Finish times of the first and second time through, for every row."""
    block = F.substring("at.h", 1, digits)
    placed = sized.withColumn("block", block)
    own = F.sum("size").over(Window.partitionBy("source", "block").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("own", own).alias("d").join(before.alias("b"), F.expr("d.source <=> b.source AND d.block = b.block")).select("d.*", "b.before")
    joined = joined.alias("d").join(flows.alias("f"), F.expr("d.source <=> f.source")).select("d.kept", "d.source", "d.size", "f.source_size", "f.target", (F.col("d.before") + F.col("d.own")).alias("words"))
    time = lambda n: F.expr(f"IF(target > 0, ({n} * source_size + words) / target, NULL)")
    return joined.withColumn("times", F.array(*[time(n) for n in range(REPEATS)]))


def _cut(timed: DataFrame, budget: float) -> float:
    """The largest finish time up to which all words fit the budget; just below the smallest if none do.

    Finish times and sizes are sorted into ranges over all partitions.  A total per range tells in
    which one the budget ends; only there running sums are taken.  Equal times share a range and
    are cut together.
    """
    items = timed.select(F.explode("times").alias("finish"), "size").where("finish is not null AND size > 0")
    ranged = items.repartitionByRange("finish").sortWithinPartitions("finish").withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "finish_order")
    ranges = ranged.groupBy("range").agg(F.sum("size").alias("words"), F.min("finish").alias("low"), F.max("finish").alias("high")).orderBy("low").collect()
    if not ranges:
        return 0.0
    served, cut = 0, math.nextafter(ranges[0].low, -math.inf)
    for r in ranges:
        if served + r.words > budget:
            running = F.sum("size").over(Window.partitionBy("range").orderBy("finish"))
            last = ranged.where(F.col("range") == r.range).withColumn("served", served + running).where(F.col("served") <= budget).agg(F.max("finish")).first()[0]
            return cut if last is None else last
        served, cut = served + r.words, r.high
    return cut


def mix(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``keep`` columns, source, size, source_size, target, taken and finish of every document.

    size is the number of words (null text: 0); taken is size times how often the mix takes the
    document (0, 1 or 2); a kept column of one of these names stays, and the result's is made longer
    by an underscore; finish is its first virtual finish time, by which the mix is ordered.
    Null sources form one source.  Repeated rows are documents of their own, ordered among each
    other by text and size; documents without words are never taken.  Where no document has words,
    targets are 0.  An empty table stays empty.  The same input gives the same mix.
    """
    narrow = materialise(_sized(docs, [doc_id], doc_id, source, text), "mix_sizes")
    flows, budget = targets(materialise(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes"), weights, share)
    flows = materialise(flows, "targets")
    digits = max(2, math.ceil(math.log(max(narrow.count(), 1) / BLOCK_ROWS + 1, 16)))
    blocks = narrow.groupBy("source", F.substring("at.h", 1, digits).alias("block")).agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(blocks.select("source", "block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before")), "block_sums")
    timed = materialise(_timed(narrow, flows, before, digits), "finish_times")
    cut = _cut(timed, budget)
    if keep != [doc_id]:
        timed = _timed(_sized(docs, keep, doc_id, source, text), flows, before, digits)
    times = F.aggregate("times", F.lit(0), lambda n, f: n + F.when(f <= F.lit(cut), 1).otherwise(0))
    made = {"source": F.col("source"), "size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("size") * times, "finish": F.col("times")[0]}
    kept = {c.lower() for c in keep if c != source}
    return timed.select(*[F.col(f"kept.`{c}`") for c in keep if c != source], *[made[n].alias(source if n == "source" else unused(n, kept)) for n in made])
