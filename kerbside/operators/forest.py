"""Random forest for several classes, grown level by level from counted rows.

Resampling rows with replacement gives each of them a Poisson(1) number of
copies; the w equal rows of a count therefore have Poisson(w) copies together.
Drawing that one number per tree is the same bootstrap of single rows, and
the work grows with the distinct (bins, label) instead of the rows. Draws are
fixed by the combination and the seed, so the trees do not depend on how the
rows are partitioned.

A level of some trees is one aggregate: each task counts copies per (tree,
node, feature drawn for the node, bin, class) of its rows, Spark adds the tasks
up, and the driver sees at most ``CELLS`` numbers at once, or those of one tree.
Splits, sets of features, pruning and importances are those of Spark ML's
forest: Gini impurity, up to 32 bins, the square root of the features per node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import boosting
from kerbside.operators.boosting import _matrix, _walk
from kerbside.session import materialise, working_tables

BINS = 32
CELLS = 4_000_000
_TREE_DDL = "tree INT, node INT, feature INT, cut INT, gain DOUBLE, counts ARRAY<DOUBLE>"


class Tree(NamedTuple):
    """Nodes in heap order, as in boosting; ``gain`` is that of all copies at a node, ``counts`` are copies per class."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    counts: np.ndarray


class Forest(NamedTuple):
    features: list[str]
    starts: list[list[float]]  # per feature the lowest value of each bin but the first
    trees: list[Tree]

    @property
    def classes(self) -> int:
        return self.trees[0].counts.shape[1]


def _empty(depth: int, classes: int) -> Tree:
    size = 2 ** (depth + 1) - 1
    return Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros((size, classes)))


def _resampled(binned: DataFrame, trees: int, seed: int) -> DataFrame:
    """(bins, label, draws): copies of the rows of a (bins, label) in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, keys = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
            draws = np.zeros((len(weights), trees), np.int64)
            for i, (weight, key) in enumerate(zip(weights, keys)):
                draws[i] = np.random.Generator(np.random.PCG64([seed, int(key)])).poisson(weight, trees)
            listed = pa.ListArray.from_arrays(
                pa.array(np.arange(0, draws.size + 1, trees), pa.int32()), pa.array(draws.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], ["bins", "label", "draws"])

    keyed = binned.withColumn("key", F.xxhash64("bins", "label"))
    return keyed.mapInArrow(run, "bins array<int>, label int, draws array<bigint>")


def _binned(counted: DataFrame, features: list[str], starts: list[list[float]], classes: int) -> DataFrame:
    wide = boosting._binned(counted, features, starts, classes)
    return wide.select("bins", F.posexplode("weights").alias("label", "weight")).where("weight > 0")


def _counts(
    growing: list[Tree], drawn: list[np.ndarray], first_tree: int, level: int, width: int, classes: int, n_features: int
) -> Callable:
    """Rows (cell, n) of a task: copies per (tree, node of the level, place of the feature, bin, class)."""
    first = 2 ** level - 1
    some = drawn[0].shape[1]
    size = 2 ** level * some * width * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(growing), size))
        for batch in batches:
            bins = _matrix(batch.column(0), n_features)
            label = batch.column(1).to_numpy()
            draws = batch.column(2).flatten().to_numpy().reshape(len(label), -1)
            for t, tree in enumerate(growing):
                copies = draws[:, first_tree + t]
                node = _walk(tree, bins) - first
                here = np.flatnonzero((node >= 0) & (copies > 0))  # rows that end in a leaf above are settled
                at = node[here]
                for place in range(some):
                    bin_ = bins[here, drawn[t][at, place]]
                    cell = ((at * some + place) * width + bin_) * classes + label[here]
                    total[t] += np.bincount(cell, copies[here], size)
        flat = total.ravel()
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells].astype(np.int64))], ["cell", "n"])
    return run


def best_splits(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node (gain of all copies, place of the feature, cut, copies per class left of it) of (nodes, places, bins, classes)."""
    left = counts.cumsum(axis=2)
    whole = left[:, :, -1:, :]

    def agreement(part: np.ndarray) -> np.ndarray:
        """Copies times (1 - Gini impurity)."""
        return (part ** 2).sum(axis=-1) / np.maximum(part.sum(axis=-1), 1)

    gain = agreement(left) + agreement(whole - left) - agreement(whole)
    both = (left.sum(axis=-1) > 0) & ((whole - left).sum(axis=-1) > 0)
    gain = np.where(both, gain, 0.0).reshape(len(counts), -1)
    at = gain.argmax(axis=1)
    place, cut = np.divmod(at, counts.shape[2])
    nodes = np.arange(len(counts))
    return gain[nodes, at], place, cut, left[nodes, place, cut]


def _grow(tree: Tree, counts: np.ndarray, drawn: np.ndarray, level: int) -> None:
    gain, place, cut, left = best_splits(counts)
    whole = counts[:, 0].sum(axis=1)
    if level == 0:
        tree.counts[0] = whole[0]
    split = np.flatnonzero(gain > 1e-9 * np.maximum(whole.sum(axis=-1), 1))
    at = 2 ** level - 1 + split
    tree.feature[at], tree.cut[at], tree.gain[at] = drawn[split, place[split]], cut[split], gain[split]
    tree.counts[2 * at + 1], tree.counts[2 * at + 2] = left[split], (whole - left)[split]


def _prune(tree: Tree) -> None:
    """Turn nodes into leaves whose two children are leaves of the same class."""
    usual = tree.counts.argmax(axis=1)
    for node in reversed(range(len(tree.feature) // 2)):
        a, b = 2 * node + 1, 2 * node + 2
        if tree.feature[node] >= 0 and tree.feature[a] < 0 and tree.feature[b] < 0 and usual[a] == usual[b]:
            tree.feature[node], tree.gain[node] = -1, 0.0


def fit(
    counted: DataFrame, features: list[str], classes: int, trees: int = 100, depth: int = 10, seed: int = 42,
    bins: int = BINS,
) -> Forest:
    """Forest from (features as numbers, label 0 .. classes - 1, weight); labels and features are not null."""
    if not 0 < classes <= boosting.CLASSES:
        raise ValueError(f"{classes} classes; 1 to {boosting.CLASSES} can be learned")
    starts = boosting.bin_starts(counted, features, bins)
    width, some = max(len(s) + 1 for s in starts), int(np.ceil(np.sqrt(len(features))))
    grown = [_empty(depth, classes) for _ in range(trees)]
    with working_tables():
        # a small table would otherwise be one task, though every row is visited for every tree and level
        binned = _binned(counted, features, starts, classes).repartition(counted.sparkSession.sparkContext.defaultParallelism)
        table = materialise(_resampled(binned, trees, seed), "resampled")
        for level in range(depth):
            nodes = 2 ** level
            size = nodes * some * width * classes
            drawn = [
                np.random.default_rng([seed, t, level]).random((nodes, len(features))).argsort(axis=1)[:, :some]
                for t in range(trees)
            ]
            step = max(1, CELLS // size)
            for first in range(0, trees, step):
                part = grown[first:first + step]
                run = _counts(part, drawn[first:first + step], first, level, width, classes, len(features))
                found = table.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
                counts = np.zeros(len(part) * size)
                counts[found["cell"].to_numpy()] = found["n"].to_numpy()
                for t, cells in enumerate(counts.reshape(len(part), nodes, some, width, classes)):
                    _grow(part[t], cells, drawn[first + t], level)
    for tree in grown:
        _prune(tree)
    return Forest(features, starts, grown)


# -- using ----------------------------------------------------------------------------

def probabilities(model: Forest) -> Column:
    """Mean of the trees' class shares of a row, from its feature columns; equal rows of a batch are scored once."""
    starts, trees, classes = model.starts, model.trees, model.classes

    @F.pandas_udf("array<double>")
    def scored(*values: pd.Series) -> pd.Series:
        bins = np.column_stack([
            np.searchsorted(s, v.to_numpy(float), side="right") for s, v in zip(starts, values)])
        distinct, place = np.unique(bins, axis=0, return_inverse=True)
        votes = np.zeros((len(distinct), classes))
        for tree in trees:
            counts = tree.counts[_walk(tree, distinct)]
            votes += counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return pd.Series(list((votes / len(trees))[place.ravel()]), dtype=object)

    return scored(*[boosting._finite(F.col(f"`{c}`")) for c in model.features])


def importances(model: Forest) -> list[float]:
    """Gain of the splits of each feature: shares per tree, added up and scaled to sum 1; all 0 without splits."""
    total = np.zeros(len(model.features))
    for tree in model.trees:
        used = tree.feature >= 0
        own = np.bincount(tree.feature[used], tree.gain[used], len(total))
        total += own / own.sum() if own.sum() else own
    return (total / total.sum() if total.sum() else total).tolist()


def save(model: Forest, spark: SparkSession, path: str) -> None:
    rows = [
        (t, i, int(tree.feature[i]), int(tree.cut[i]), float(tree.gain[i]), tree.counts[i].tolist())
        for t, tree in enumerate(model.trees)
        for i in range(len(tree.feature)) if i == 0 or tree.feature[(i - 1) // 2] >= 0
    ]
    depth = int(np.log2(len(model.trees[0].feature) + 1)) - 1
    spark.createDataFrame(rows, _TREE_DDL).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame(
        [(model.features, model.starts, model.classes, depth, len(model.trees))],
        "features ARRAY<STRING>, starts ARRAY<ARRAY<DOUBLE>>, classes INT, depth INT, trees INT",
    ).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Forest:
    about = spark.read.parquet(f"{path}/about").first()
    trees = [_empty(about["depth"], about["classes"]) for _ in range(about["trees"])]
    for r in spark.read.parquet(f"{path}/trees").collect():
        tree, i = trees[r["tree"]], r["node"]
        tree.feature[i], tree.cut[i], tree.gain[i], tree.counts[i] = r["feature"], r["cut"], r["gain"], r["counts"]
    return Forest(list(about["features"]), [list(s) for s in about["starts"]], trees)
