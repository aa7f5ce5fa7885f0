"""Accident tables: CSV and Parquet in and out, input choice, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.schema import ACCIDENT_DDL
from kerbside.session import materialise
from kerbside.sources.records import QUOTING, read_records

# Texts that mean "missing" in an uploaded CSV (the usual pandas list).
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# What counts as a number in an upload; the engine's cast would also take 1d, 2f and 0x1p3.
_NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def read_accidents(spark: SparkSession, path: str, ddl: str = ACCIDENT_DDL, multi_line: bool = False) -> DataFrame:
    """Canonical CSV. The schema is declared: inference costs a scan and turns 08:30 into a date.

    ``multi_line`` lets quoted text hold line breaks (see ``sources.records``).
    """
    if multi_line:
        return read_records(spark, path, ddl)
    return spark.read.schema(ddl).options(header=True, **QUOTING).csv(path)


def read_upload(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A user's CSV with unknown headers, parsed once. Columns holding only numbers become numbers; times stay text.

    ``multi_line`` as in ``read_accidents``.
    """
    if multi_line:
        text = read_records(spark, path)
    else:
        text = spark.read.options(header=True, inferSchema=False, **QUOTING).csv(path)
    known = [
        F.when(~F.col(f"`{c}`").isin(MISSING_TEXTS), F.col(f"`{c}`")).alias(c) for c in text.columns
    ]
    # written under numbers: a header may hold any character
    numbered = materialise(
        text.select(*known).toDF(*[f"column{i}" for i in range(len(known))]), "upload")
    return infer_numbers(numbered.toDF(*text.columns))


def infer_numbers(df: DataFrame) -> DataFrame:
    """Cast text columns whose values are all numeric: whole and without gaps to BIGINT, else DOUBLE.

    Texts like 1d, 2f or 0x1p3, which the engine would read as numbers, stay texts.
    One aggregate over the table decides for all columns.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    tests = []
    for i, name in enumerate(names):
        value = F.btrim(F.col(f"`{name}`"))
        tests += [
            F.count(value).alias(f"filled{i}"),
            F.count_if(value.isNotNull() & ~(value.rlike(_NUMBER) & value.try_cast("double").isNotNull())).alias(f"words{i}"),
            F.count_if(value.isNull() | value.try_cast("bigint").isNull() | value.contains(".")).alias(f"broken{i}"),
        ]
    found = df.agg(*tests).first()
    kinds = {}
    for i, name in enumerate(names):
        if found[f"filled{i}"] and not found[f"words{i}"]:
            kinds[name] = "double" if found[f"broken{i}"] else "bigint"
    return df.select(*[
        F.btrim(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns
    ])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, **QUOTING).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def active_table(uploaded: DataFrame | None, sample: DataFrame) -> DataFrame:
    return sample if uploaded is None else uploaded


def preview(df: DataFrame, order: list[str | Column], rows: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(rows)
