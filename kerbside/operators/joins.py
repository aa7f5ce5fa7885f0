"""Equi-joins that stay balanced when single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# No side is broadcast beyond this many rows.
BROADCAST_ROWS = 500_000
# A key is split off only above this many rows, so ordinary data takes one plain join.
SPLIT_ROWS = 200_000


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    right_rows_per_key: int = 1,
    split_rows: int = SPLIT_ROWS,
    left_rows: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join where ``left`` may hold any number of rows per key.

    ``right`` has at most ``right_rows_per_key`` rows per key. Keys with more
    than ``t`` left rows, ``t = max(split_rows, n * right_rows_per_key /
    BROADCAST_ROWS)``, number fewer than ``n / t``; their right rows are
    therefore at most ``BROADCAST_ROWS`` and are broadcast, so a heavy key is
    never shuffled. All other keys go through an ordinary join. ``how`` is
    ``inner`` or ``left``; keys of ``left`` must not be null. ``left_rows`` is a
    known bound on the rows of ``left``: when it rules out heavy keys, they are
    not searched for. ``counts`` may give known (or larger) row numbers per key
    as a table of the key columns and ``rows``; otherwise ``left`` is counted.
    """
    if left_rows is not None and left_rows <= split_rows:
        return left.join(right, on, how)
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
    total, largest = counts.agg(F.sum("rows"), F.max("rows")).first()
    limit = max(split_rows, (total or 0) * right_rows_per_key // BROADCAST_ROWS)
    if (largest or 0) <= limit:
        return left.join(right, on, how)
    heavy = F.broadcast(counts.where(F.col("rows") > limit).select(*on))
    head = left.join(heavy, on, "left_semi").join(
        F.broadcast(right.join(heavy, on, "left_semi")), on, how
    )
    tail = left.join(heavy, on, "left_anti").join(right, on, how)
    return head.unionByName(tail)
