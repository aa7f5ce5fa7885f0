"""Isolation forest over the numeric accident columns.

Trees are grown from small random samples, as the method prescribes, one task
per tree. Scores depend only on the values, so each distinct combination is
scored once, with its number of rows as weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.joins import BROADCAST_ROWS, skew_join
from kerbside.operators.quantiles import exact_quantiles
from kerbside.session import materialise, working_tables

COLUMNS = ["speed_limit", "num_vehicles", "num_casualties"]
TREES = 100
SAMPLE = 256          # rows per tree
_EULER = 0.5772156649015329
_NODES_DDL = "tree INT, node INT, feature INT, split DOUBLE, left INT, right INT, path DOUBLE"


class Anomalies(NamedTuple):
    data: DataFrame    # input plus is_anomaly
    stats: DataFrame   # one row


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def _grow(sample: pd.DataFrame, columns: list[str], seed: int) -> pd.DataFrame:
    """Random splits until rows are alone, equal, or at depth log2(sample)."""
    tree = int(sample["tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    values = sample.sort_values("draw")[columns].to_numpy(float)
    limit = math.ceil(math.log2(max(len(values), 2)))
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        node = len(nodes)
        nodes.append([tree, node, -1, 0.0, -1, -1, depth + _average_path(len(rows))])
        low, high = rows.min(axis=0), rows.max(axis=0)
        choices = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(choices):
            feature = int(rng.choice(choices))
            split = float(rng.uniform(low[feature], high[feature]))
            below = rows[:, feature] <= split
            left, right = add(rows[below], depth + 1), add(rows[~below], depth + 1)
            nodes[node][2:6] = [feature, split, left, right]
        return node

    add(values, 0)
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "path"])


def _samples(profiles: DataFrame, columns: list[str], n: int, size: int, seed: int) -> DataFrame:
    """(tree, draw, *columns): ``size`` different rows of all ``n`` per tree.

    Row numbers are drawn first; they run through the counted combinations in
    the order of their values, so a number names a combination whatever the
    partitioning. Each partition looks up the numbers that fall to it.
    """
    numbers = np.concatenate([
        np.random.default_rng([seed, tree, 1]).choice(n, size, replace=False) for tree in range(TREES)])
    order = np.argsort(numbers, kind="stable")
    sorted_numbers = numbers[order]

    placed = materialise(profiles.orderBy(*columns).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("_part").agg(F.sum("n").alias("_size"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("_upto", F.sum("n").over(within)).join(F.broadcast(starts), "_part").select(
        *columns, "n", (F.col("_start") + F.col("_upto") - F.col("n")).alias("_first"))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low = np.searchsorted(sorted_numbers, batch["_first"])
            count = np.searchsorted(sorted_numbers, batch["_first"] + batch["n"]) - low
            if count.sum():
                taken = batch.loc[batch.index.repeat(count), columns]
                place = np.concatenate([np.arange(a, a + c) for a, c in zip(low, count) if c])
                yield taken.assign(tree=order[place] // size, draw=order[place] % size)[["tree", "draw", *columns]]

    schema = "tree INT, draw BIGINT, " + ", ".join(f"{c} DOUBLE" for c in columns)
    return numbered.mapInPandas(look_up, schema)


def _scorer(forest: pd.DataFrame, columns: list[str], sample_size: int):
    trees = [g.sort_values("node").drop(columns=["tree", "node"]).to_numpy(float) for _, g in forest.groupby("tree")]
    scale = _average_path(sample_size) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[columns].to_numpy(float)
            rows = np.arange(len(values))
            depth = np.zeros(len(values))
            for tree in trees:
                at = np.zeros(len(values), int)
                while True:
                    feature = tree[at, 0].astype(int)
                    inner = feature >= 0
                    if not inner.any():
                        break
                    below = values[rows, np.maximum(feature, 0)] <= tree[at, 1]
                    step = np.where(below, tree[at, 2], tree[at, 3]).astype(int)
                    at = np.where(inner, step, at)
                depth += tree[at, 4]
            yield batch.assign(score=-np.exp2(-depth / len(trees) / scale))

    return score


def detect_anomalies(
    df: DataFrame, contamination: float = 0.1, seed: int = 42
) -> Anomalies:
    """Flag the rows scoring below the ``contamination`` quantile of all scores.

    Samples are drawn from all rows in the order of their values, so results do
    not depend on partitioning. Fewer than two usable columns or ten complete rows
    flag nothing.
    """
    with working_tables() as keep:
        return _detect(df, contamination, seed, keep)


def _detect(
    df: DataFrame, contamination: float, seed: int, keep: list[DataFrame]
) -> Anomalies:
    spark = df.sparkSession
    columns = [c for c in COLUMNS if c in df.columns]
    stats_ddl = "n_anomalies BIGINT, percentage DOUBLE, n_rows BIGINT, threshold DOUBLE, features_used ARRAY<STRING>"

    def nothing(n: int) -> Anomalies:
        return Anomalies(
            df.withColumn("is_anomaly", F.lit(False)),
            spark.createDataFrame([(0, 0.0, n, None, columns)], stats_ddl),
        )

    if len(columns) < 2:
        return nothing(0)
    complete = df.dropna(subset=columns)
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    profiles = materialise(
        complete.select(*doubles).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")), "profiles"
    )
    n, n_profiles = profiles.agg(F.sum("n"), F.count(F.lit(1))).first()
    if (n or 0) < 10:
        return nothing(n or 0)

    size = min(SAMPLE, n)
    samples = _samples(profiles, columns, n, size, seed)
    forest = (
        samples.groupBy("tree")
        .applyInPandas(lambda pdf: _grow(pdf, columns, seed), _NODES_DDL)
        .toPandas()  # at most TREES * (2 * SAMPLE - 1) nodes
    )
    schema = ", ".join(f"{c} DOUBLE" for c in columns) + ", n BIGINT, score DOUBLE"
    scored = materialise(profiles.mapInPandas(_scorer(forest, columns, size), schema), "scores")
    keep.append(scored)  # the flagged table reads it when it is used
    threshold = exact_quantiles(scored, ["score"], contamination, weight="n")["score"]
    flags = scored.withColumn("is_anomaly", F.col("score") < F.lit(threshold))
    found = flags.agg(F.coalesce(F.sum(F.when(F.col("is_anomaly"), F.col("n"))), F.lit(0))).first()[0]

    outliers = flags.where("is_anomaly").select(
        *[F.col(c).alias(f"_{c}") for c in columns], "is_anomaly"
    )
    keys = [f"_{c}" for c in columns]
    keyed = df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns})
    if n_profiles <= BROADCAST_ROWS:
        data = keyed.join(F.broadcast(outliers), keys, "left")
    else:
        data = skew_join(keyed, outliers, keys, "left")
    data = data.drop(*keys).withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))
    stats = spark.createDataFrame(
        [(found, float(np.round(found / n * 100, 1)), n, threshold, columns)], stats_ddl
    )
    return Anomalies(data, stats)
