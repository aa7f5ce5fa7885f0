"""Positions in a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row position below


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "ordinal") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (which must be total).

    One range shuffle sorts the rows; positions inside a partition are exact,
    and the partition sizes (one row per partition) give the offsets.
    """
    placed = materialise(
        df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ordinal"
    )
    part = F.shiftright("_place", _ROW_BITS)
    within = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(within) + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + within)
        .drop("_part", "_offset", "_place")
    )


def with_running_sum(df: DataFrame, order: list[str | Column], weight: str, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows up to and including each row in ``order`` (which must be total).

    One range shuffle sorts the rows; sums run within a partition, and the
    partition totals (one row per partition) give the offsets.
    """
    placed = materialise(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "running")
    placed = placed.withColumn("_part", F.shiftright("_place", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.sum(weight).alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.sum(weight).over(
        Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        placed.withColumn(name, within)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col(name))
        .drop("_part", "_offset", "_place")
    )
