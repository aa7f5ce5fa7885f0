"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows handed to a Python worker at once: texts may be long, so few of them travel together.
BATCH_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session send at most ``BATCH_ROWS`` rows to a Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(key)) > BATCH_ROWS or int(conf.get(key)) <= 0:
        conf.set(key, str(BATCH_ROWS))
    return df


def column(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(names: list[str]) -> list[Column]:
    """Columns under neutral names ``_kept_0``, ``_kept_1`` ..., so that none clashes with working columns."""
    return [column(name).alias(f"_kept_{i}") for i, name in enumerate(names)]


def restored(names: list[str]) -> list[Column]:
    """The numbered columns under their own names again."""
    return [F.col(f"_kept_{i}").alias(name) for i, name in enumerate(names)]


def numbered_schema(df: DataFrame, names: list[str]) -> str:
    return "".join(f"_kept_{i} {df.schema[name].dataType.simpleString()}, " for i, name in enumerate(names))


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of the links (a, b) with the smallest id it is connected to, itself left out.

    At most one link per id remains, whatever the number of links, and the
    same ids stay connected.
    """
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[left], root[right])
        step = root.copy()
        np.minimum.at(step, root[left], low)
        np.minimum.at(step, root[right], low)
        while (step[step] != step).any():
            step = step[step]
        step = step[root]
        if (step == root).all():
            break
        root = step
    moved = ids[root] != ids
    return ids[moved], ids[root][moved]
