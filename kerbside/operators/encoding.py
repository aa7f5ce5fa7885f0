"""Integer codes for category columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import schema as S
from kerbside.operators.joins import BROADCAST_ROWS, skew_join
from kerbside.operators.ordinals import with_ordinal
from kerbside.session import materialise


def _distinct_values(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return (
        df.select(F.col(order).alias("_order"), F.explode(pairs).alias("p"))
        .groupBy(F.col("p.column").alias("column"), F.col("p.value").alias("value"))
        .agg(F.min("_order").alias("first_row"))
    )


def _dense(values: DataFrame, order: list[str]) -> DataFrame:
    """0-based codes within each column, from one sort of all values."""
    placed = with_ordinal(values, ["column", *order], "_n")
    starts = placed.groupBy("column").agg(F.min("_n").alias("_start"))
    return (
        placed.join(F.broadcast(starts), "column")
        .withColumn("code", (F.col("_n") - F.col("_start")).cast("int"))
        .drop("_n", "_start")
    )


def first_seen_codes(
    df: DataFrame, order: str, columns: list[str] | None = None
) -> DataFrame:
    """Encoding table (column, value, first_row, code): codes count first appearances by ``order``."""
    present = [c for c in columns or S.FACTOR_COLUMNS if c in df.columns]
    return _dense(_distinct_values(df, present, order), ["first_row"])


def grow_codes(codes: DataFrame, df: DataFrame, order: str) -> DataFrame:
    """``codes`` (column, value, code) and codes for the values of ``df`` that it lacks.

    Codes given once never change: new values get the next numbers of their
    column, by first appearance in ``df``. So what was encoded or learned with
    the old table stays right, and a stream can go on with the new one.
    """
    known = materialise(codes.select("column", "value", "code"), "codes")
    sizes = {r["column"]: r["size"] for r in known.groupBy("column").agg((F.max("code") + 1).alias("size")).collect()}
    values = _distinct_values(df, [c for c in sizes if c in df.columns], order)
    same = (F.col("new.column") == F.col("old.column")) & F.col("new.value").eqNullSafe(F.col("old.value"))
    fresh = _dense(values.alias("new").join(known.alias("old"), same, "left_anti"), ["first_row"])
    offset = F.lit(0)
    for column, size in sizes.items():
        offset = F.when(F.col("column") == column, F.lit(size)).otherwise(offset)
    return known.unionByName(fresh.select("column", "value", (F.col("code") + offset).cast("int").alias("code")))


def alphabetical_codes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Encoding table (column, value, code) in alphabetical order of the values."""
    present = [c for c in columns or S.LABEL_COLUMNS if c in df.columns]
    keyed = df.select(*present).withColumn("_zero", F.lit(0))
    return _dense(_distinct_values(keyed, present, "_zero").drop("first_row"), ["value"])


def apply_codes(df: DataFrame, codes: DataFrame, unknown: int | None = None) -> DataFrame:
    """Add ``<column>_encoded``. The table is broadcast only when its size allows."""
    codes = materialise(codes.select("column", "value", "code"), "codes")
    counts = {r["column"]: r["count"] for r in codes.groupBy("column").count().collect()}
    for column in [c for c in df.columns if c in counts]:
        table = codes.where(F.col("column") == column).select(
            F.col("value").alias("_value"), F.col("code").alias(f"{column}_encoded")
        )
        keyed = df.withColumn("_value", F.col(column).cast("string"))
        if counts[column] <= BROADCAST_ROWS:
            df = keyed.join(F.broadcast(table), "_value", "left").drop("_value")
        else:
            keyed = keyed.withColumn("_value", F.coalesce("_value", F.lit("")))
            df = skew_join(keyed, table, ["_value"], "left").drop("_value")
        if unknown is not None:
            name = f"{column}_encoded"
            df = df.withColumn(name, F.coalesce(name, F.lit(unknown)))
    return df
