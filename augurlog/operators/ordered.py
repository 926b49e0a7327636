"""Order-dependent building blocks that never sort a whole table in one task.

* ``running_totals``  – prefix sums over a global order (bins by value range)
* ``exact_quantiles`` – interpolated quantiles from running counts
* ``previous_value``  – the value before a row inside a group of any size
* ``global_rank``     – row numbers over a global order
* ``largest``         – the n rows of largest value, for any n
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augurlog.functions.timestamps import epoch_micros
from augurlog.session import materialise

# Lines of one instant are cut into blocks of this many line numbers.
LINE_BLOCK = 1 << 16
# Rows of one value range of a running total; every range is one group of one task.
RANGE_ROWS = 100_000


def value_cuts(df: DataFrame, value: str, bins: int) -> list[float]:
    """At most ``bins - 1`` increasing cut points that spread the rows of ``df``."""
    if bins < 2:
        return []
    probabilities = [i / bins for i in range(1, bins)]
    return sorted(set(df.approxQuantile(value, probabilities, 0.5 / bins)))


def with_bin(df: DataFrame, value: str, cuts: list[float], name: str = "_bin") -> DataFrame:
    """Adds the index of the half-open range between cuts that holds ``value`` (0..len(cuts)),
    found by binary search."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *map(float, cuts), float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="_value", outputCol=name, handleInvalid="keep")
    return ranges.transform(df.withColumn("_value", F.col(value).cast("double"))).withColumn(name, F.col(name).cast("int")).drop("_value")


def running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, str],
    descending: bool = False,
    bins: int | None = None,
) -> DataFrame:
    """Inclusive prefix sums over the order of ``value``, which must be distinct.

    ``sums`` maps a new column to the column it accumulates.  Rows are spread over
    value ranges of about equal row counts (``RANGE_ROWS``, so their number grows
    with the table); every range is summed on its own, and the totals of the ranges
    before it (one row per range) are added.  The table is written first, so what it
    comes from is computed once, and the cut points are fixed before the plan is
    built, so both branches see the same ranges.
    """
    df = materialise(df, "ordered")
    bins = bins or -(-df.count() // RANGE_ROWS)
    cuts = value_cuts(df, value, bins)
    binned = with_bin(df, value, cuts)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy("_bin")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    bin_order = F.col("_bin").desc() if descending else F.col("_bin").asc()
    # One row per range, len(cuts) + 1 in all.
    before = Window.orderBy(bin_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy("_bin")
        .agg(*[F.sum(src).alias(f"_t_{name}") for name, src in sums.items()])
        .select(
            "_bin",
            *[
                F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
                for name in sums
            ],
        )
    )
    local = binned.select(
        "*", *[F.sum(src).over(inside).alias(f"_l_{name}") for name, src in sums.items()]
    )
    return local.join(F.broadcast(offsets), "_bin").select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
    )


def exact_quantiles(df: DataFrame, value: str, levels: list[float], bins: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles: one row ``(level, quantile)`` per level.

    Equal values are counted once, counts are accumulated over the value order,
    and the two rows around each wanted position are picked.  No buffer grows
    with the number of distinct values.
    """
    counted = materialise(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), "counted")
    ranked = running_totals(counted, value, {"_upto": "_n"}, bins=bins)
    total = counted.agg(F.sum("_n").alias("_total"))
    wanted = F.array(*[F.lit(float(q)) for q in levels])
    position = lambda q: q * (F.col("_total") - 1)
    covers = lambda pos: (pos >= F.col("_upto") - F.col("_n")) & (pos < F.col("_upto"))
    hits = (
        ranked.withColumn("_total", total.scalar())
        .withColumn(
            "_level",
            F.explode(
                F.filter(
                    wanted,
                    lambda q: covers(F.floor(position(q))) | covers(F.ceil(position(q))),
                )
            ),
        )
    )
    pos = position(F.col("_level"))
    low = F.max(F.when(covers(F.floor(pos)), F.col(value)))
    high = F.max(F.when(covers(F.ceil(pos)), F.col(value)))
    share = F.max(pos - F.floor(pos))
    return (
        hits.groupBy(F.col("_level").alias("level"))
        .agg(low.alias("_low"), high.alias("_high"), share.alias("_share"))
        .select("level", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("quantile"))
    )


def previous_value(
    df: DataFrame, keys: list[str], ts: str, line_no: str, first: str, last: str, span_us: int
) -> DataFrame:
    """Pairs ``(previous row's last, this row's first)`` along ``(ts, line_no)``.

    Returns ``keys, prev, next``.  A group is cut three times into runs that are
    contiguous in the order: lines of one instant and one block of line numbers;
    instants of one slice of the window span; slices.  Each run links its rows and
    hands one row (its first and last value) to the next level, so no task sorts a
    whole hot group.
    """
    staged = df.select(
        *keys,
        F.col(ts).alias("_ts"),
        F.floor(F.col(line_no) / LINE_BLOCK).alias("_block"),
        F.floor(epoch_micros(F.col(ts)) / F.lit(max(1, span_us // 1024))).alias("_slice"),
        F.col(line_no).alias("_line"),
        F.col(first).alias("_first"),
        F.col(last).alias("_last"),
    )
    levels = [
        (["_slice", "_ts", "_block"], ["_line"]),
        (["_slice"], ["_ts", "_block"]),
        ([], ["_slice"]),
    ]
    linked, current = [], staged
    for run, order in levels:
        part = Window.partitionBy(*keys, *run)
        ordered = part.orderBy(*order)
        # Both branches below start from this one shuffle, which Spark reuses.
        seen = current.withColumns(
            {
                "_prev": F.lag("_last").over(ordered),
                "_tail": F.last("_last").over(
                    ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                ),
            }
        )
        linked.append(
            seen.where(F.col("_prev").isNotNull()).select(*keys, F.col("_prev").alias("prev"), F.col("_first").alias("next"))
        )
        # the first row of a run stands for the run on the next level
        current = seen.where(F.col("_prev").isNull()).select(*keys, *run, "_first", F.col("_tail").alias("_last"))
    out = linked[0]
    for more in linked[1:]:
        out = out.unionByName(more)
    return out


def global_rank(df: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """1-based row number over the given order, without a sort or window in one task.

    Rows are dealt out by ranges of the order and written; the place within a range is
    shifted by the counts of the ranges before (one row per shuffle partition).
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(shifts), "_part")
        .withColumn(name, (F.expr("_id & 8589934591") + F.col("_before") + 1))
        .drop("_id", "_part", "_before")
    )


def largest(df: DataFrame, n: int, value: str, tie: str) -> DataFrame:
    """The ``n`` rows of largest ``value``, ties by smaller ``tie``; all, if there are no more.

    A limit behind a sort would bring n rows of every task to one.  Here the value at which
    the n-th row stands is found from the counts of the values, and the rows of that value
    are ranked by ranges of ``tie``.  Rows with a null value come last.
    """
    df = materialise(df, "largest")
    if n < 1 or df.count() <= n:
        return df if n > 0 else df.limit(0)
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    reached = running_totals(counted, value, {"_upto": "_n"}, descending=True)
    at = reached.where((F.col("_upto") >= n) & (F.col("_upto") - F.col("_n") < n)).first()
    if at is None:  # fewer rows with a value than wanted
        above, level = df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())
        missing = n - above.count()
    else:
        above, level = df.where(F.col(value) > at[value]), df.where(F.col(value) == at[value])
        missing = n - (at["_upto"] - at["_n"])
    ranked = global_rank(level, tie, name="_rank").where(F.col("_rank") <= missing).drop("_rank")
    return above.unionByName(ranked)
