"""Window functions over the rows of a series of any length.

Frames that look a fixed number of rows back or ahead need no task that holds a whole
series.  A series is cut into weeks; every week computes its rows.  A row near the edge of its
week may miss neighbours, so the rows at the edges - a few per week, however many the week has -
are gathered again over the series.  Between two edge rows nothing is left out that a frame could
reach: a week may hold fewer rows than a frame, then all of them are edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from augurlog.session import materialise

#: Days per run of the levels below the whole series.
DAY, RUNS = 86_400, (7,)


def over_rows(
    df: DataFrame, compute: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0,
    series: str = "source_file", order: str = "bucket", settled: Column | None = None,
) -> DataFrame:
    """``df`` with the columns that ``compute`` makes of windows ordered by ``order`` within ``series``.

    ``compute(w)`` returns expressions over ``w``, the partitioned and ordered window; their frames
    must lie within ``before`` rows back and ``after`` rows ahead of the current row, and ``lag`` and
    ``lead`` count likewise.  The result equals the window over ``Window.partitionBy(series)``.
    Rows of equal order are in no fixed order, as there.  ``settled``, a condition that may use the
    new columns, drops rows before they are returned.
    """
    edge = before + after
    day = F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / F.lit(DAY))
    runs = [F.floor(day / F.lit(n)) for n in RUNS] + [F.lit(0)]
    current, done = df.withColumn("_open", F.lit(True)), []
    for level, run in enumerate(runs):
        last = level == len(runs) - 1
        part = Window.partitionBy(series, "_run")
        rows = part.orderBy(order)
        whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        seen = current.withColumn("_run", run)
        seen = seen.withColumns({**compute(rows), "_at": F.row_number().over(rows), "_left": F.count(F.lit(1)).over(whole) - F.row_number().over(rows)})
        if level == 0:
            # both ways on start from this table, so that what it comes from is computed once
            seen = materialise(seen, "rows")
        inside = F.lit(True) if last else (F.col("_at") > before) & (F.col("_left") >= after)
        keep = F.col("_open") & inside if settled is None else F.col("_open") & inside & settled
        done.append(seen.where(keep).drop("_open", "_run", "_at", "_left"))
        if last:
            break
        at_edge = (F.col("_at") <= edge) | (F.col("_left") < edge)
        current = seen.where(at_edge).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_open") & ~inside).alias("_open"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
