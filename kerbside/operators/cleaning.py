"""Cleaning and standardising of accident tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside import schema as S
from kerbside.functions.scalars import recode, strip_lower, title_case
from kerbside.operators.ordinals import with_ordinal
from kerbside.operators.quantiles import exact_quantiles
from kerbside.session import materialise

_CHANGES_DDL = "step INT, kind STRING, column STRING, n BIGINT, message STRING"


# -- headers -------------------------------------------------------------------

def normal_header(name: str, dashes: bool = False) -> str:
    plain = name.strip().lower().replace(" ", "_")
    return plain.replace("-", "_") if dashes else plain


def normalise_headers(df: DataFrame, dashes: bool = False) -> DataFrame:
    return df.toDF(*[normal_header(c, dashes) for c in df.columns])


def alias_plan(columns: list[str]) -> list[tuple[str, str]]:
    """Renames to apply; a canonical name is taken once, by its first listed alias."""
    have = set(columns)
    plan = []
    for old, new in S.COLUMN_ALIASES:
        if old in have and new not in have:
            plan.append((old, new))
            have.remove(old)
            have.add(new)
    return plan


def apply_aliases(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(dict(alias_plan(df.columns)))


# -- missing values --------------------------------------------------------------

class Fills(NamedTuple):
    """What imputation found: missing counts and the value used, per column."""

    rows: int
    missing: dict[str, int]
    medians: dict[str, float | None]
    modes: dict[str, str]


def _kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    textual = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.DateType))]
    return numeric, textual


def _is_missing(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def exact_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent text per column, smallest on ties, ``Unknown`` when all are null.

    Counts values by shuffle with partial aggregation, so a column with any
    number of distinct values is fine.
    """
    if not columns:
        return {}
    pairs = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns
    ])
    best = (
        df.select(F.explode(pairs).alias("p")).select("p.*")
        .where("value IS NOT NULL")
        .groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"))
        .select("name", "top.value")
    )
    modes = dict.fromkeys(columns, "Unknown")
    modes.update({r["name"]: r["value"] for r in best.collect()})
    return modes


def find_fills(df: DataFrame) -> Fills:
    numeric, textual = _kinds(df)
    names = numeric + textual
    row = df.agg(
        F.count(F.lit(1)), *[F.count_if(_is_missing(df, c)) for c in names]
    ).first()
    missing = {c: n for c, n in zip(names, row[1:], strict=True) if n}
    return Fills(
        rows=row[0],
        missing=missing,
        medians=exact_quantiles(df, [c for c in numeric if c in missing]),
        modes=exact_modes(df, [c for c in textual if c in missing]),
    )


def apply_fills(df: DataFrame, fills: Fills) -> DataFrame:
    """Numeric columns that had gaps become doubles: a median need not be whole."""
    filled = []
    for field in df.schema:
        name, column = field.name, F.col(f"`{field.name}`")
        if fills.medians.get(name) is not None:
            value = F.lit(fills.medians[name])
            column = F.when(_is_missing(df, name), value).otherwise(column.cast("double"))
        elif name in fills.modes:
            column = F.coalesce(column, _mode_literal(fills.modes[name], field.dataType))
        filled.append(column.alias(name))
    return df.select(*filled)


def _mode_literal(value: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.lit(None if value == "Unknown" else value).cast(kind)
    return F.lit(value)


def clean(df: DataFrame) -> DataFrame:
    """Drop identical rows, fill gaps, then normalise headers."""
    distinct = materialise(df.dropDuplicates(), "distinct")
    return normalise_headers(apply_fills(distinct, find_fills(distinct)))


# -- vocabularies ------------------------------------------------------------------

def standard_severity(value: Column) -> Column:
    """Anything unknown becomes Minor; codes read from a float column lose their ``.0`` first."""
    text = F.regexp_replace(strip_lower(value), r"\.0$", "")
    return recode(text, S.SEVERITY_WORDS, F.lit("Minor"))


def known_severity(value: Column) -> Column:
    text = F.regexp_replace(strip_lower(value), r"\.0$", "")
    return text.isin([w for words in S.SEVERITY_WORDS.values() for w in words])


def standard_weather(value: Column) -> Column:
    text = strip_lower(value)
    return recode(text, S.WEATHER_WORDS, title_case(text))


def standard_road_type(value: Column) -> Column:
    text = strip_lower(value)
    return recode(F.replace(text, F.lit(" "), F.lit("_")), S.ROAD_WORDS, title_case(text))


_STANDARD = {
    "severity": standard_severity,
    "weather": standard_weather,
    "road_type": standard_road_type,
}


def standardise_vocabulary(df: DataFrame) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c, f in _STANDARD.items() if c in df.columns})


# -- identifiers -----------------------------------------------------------------

def accident_label(number: Column) -> Column:
    """``ACC`` and at least six digits; longer numbers are kept whole."""
    return F.format_string("ACC%06d", number)


def generate_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows 1, 2, ... in ``order`` and label them."""
    numbered = with_ordinal(df, order, "_n")
    return numbered.withColumn("accident_id", accident_label(F.col("_n") + 1)).drop("_n")


# -- the whole upload pipeline ------------------------------------------------------

class Optimised:
    """The standardised table, a report of one row, and one row per change or warning in order.

    Identifiers cost a sort of the whole table, so ``data`` is formed on first use.
    """

    def __init__(self, form: Callable[[], DataFrame], report: DataFrame, changes: DataFrame):
        self._form, self.report, self.changes = form, report, changes

    @cached_property
    def data(self) -> DataFrame:
        return self._form()


def optimise(df: DataFrame, order: list[str] | None = None) -> Optimised:
    """Standardise an uploaded table and report what was done.

    ``order`` gives the row order used when identifiers must be generated
    (default: all columns, left to right). Column names in it are looked up
    after header normalisation and aliasing.
    """
    spark = df.sparkSession
    changes: list[tuple] = []

    def note(kind: str, column: str | None, n: int, message: str) -> None:
        changes.append((len(changes) + 1, kind, column, n, message))

    named = normalise_headers(df, dashes=True)
    renames = alias_plan(named.columns)
    named = named.withColumnsRenamed(dict(renames))
    if renames:
        listing = ", ".join(f"{old} -> {new}" for old, new in renames)
        note("renamed", None, len(renames), f"Renamed columns: {listing}")

    original = named.count()
    distinct = materialise(named.dropDuplicates(), "distinct")
    fills = find_fills(distinct)
    removed = original - fills.rows
    quality = 100.0
    if removed:
        quality -= min(10.0, removed / original * 100)
        note("duplicates", None, removed, f"Removed {removed} duplicate rows")
    filled = apply_fills(distinct, fills)
    for name, n in fills.missing.items():
        how = "median" if name in fills.medians else "mode"
        note(f"{how}_fill", name, n, f"Filled {n} missing values in '{name}' with {how}")

    checks = {}
    if "severity" in filled.columns:
        checks["unknown"] = F.count_if(~known_severity(F.col("severity")))
    if "latitude" in filled.columns:
        checks["lat"] = F.count_if(~F.col("latitude").cast("double").between(-90, 90))
    if "longitude" in filled.columns:
        checks["lon"] = F.count_if(~F.col("longitude").cast("double").between(-180, 180))
    found = dict.fromkeys(("unknown", "lat", "lon"), 0)
    if checks:
        found |= filled.agg(*[c.alias(k) for k, c in checks.items()]).first().asDict()
    if found["unknown"]:
        note("severity", "severity", found["unknown"],
             f"Standardized {found['unknown']} severity values")
    for key, column in (("lat", "latitude"), ("lon", "longitude")):
        if found[key]:
            quality -= 5
            note("warning", column, found[key],
                 f"{found[key]} rows have invalid {column} values")

    data = standardise_vocabulary(filled)
    columns = list(data.columns)
    if "accident_id" not in columns:
        columns.append("accident_id")
        note("generated_ids", "accident_id", fills.rows, "Generated accident IDs")

    def form() -> DataFrame:
        return data if "accident_id" in data.columns else generate_ids(data, order or data.columns)

    report = spark.createDataFrame(
        [(original, len(df.columns), fills.rows, len(columns), removed,
          found["unknown"], found["lat"], found["lon"], max(0.0, quality))],
        "original_rows BIGINT, original_cols INT, final_rows BIGINT, final_cols INT, "
        "duplicates_removed BIGINT, severities_replaced BIGINT, invalid_latitude BIGINT, "
        "invalid_longitude BIGINT, quality_score DOUBLE",
    )
    return Optimised(form, report, spark.createDataFrame(changes, _CHANGES_DDL))


def append_records(table: DataFrame, records: DataFrame) -> DataFrame:
    """Add rows; columns one side lacks become null. Derive features after this, not before."""
    return table.unionByName(records, allowMissingColumns=True)
