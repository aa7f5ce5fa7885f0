"""Second-order boosted trees for several classes, grown level by level from histograms.

Values become bins: every distinct value its own up to ``BINS`` of them, else
weighted quantiles. Rows are then counted per distinct combination of bins, with
one weight per class. A round grows one tree per class on the softmax gradients
and hessians of that table. A level of all trees is one aggregate: each task sums
gradients and hessians per (class, node, feature, bin) of its rows, Spark adds
the tasks up, and the driver sees bounded histograms only, whatever the rows.
Sums are in whole numbers (fixed point), so the trees do not depend on how the
rows are partitioned. A table of at most ``LOCAL_ROWS`` combinations is itself
no larger than such histograms: it is collected once and summed in place, with
the same trees, instead of starting a job per level.

A split of a node into left and right gains
  GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l),
a leaf has the value -G / (H + l) times the learning rate; l is the penalty.
Ties go to the first feature, then to the lowest cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.ordinals import with_running_sum
from kerbside.session import materialise, working_tables

BINS = 256
CLASSES = 64
LOCAL_ROWS = 50_000
PENALTY = 1.0
MIN_HESSIAN = 1.0  # least hessian of a child
MIN_GAIN = 1e-6
_LEAST_HESSIAN = 1e-16
_REWRITE = 10  # rounds after which the scores are written anew
_TREE_DDL = "round INT, class INT, node INT, feature INT, cut INT, gain DOUBLE, value DOUBLE"


class Tree(NamedTuple):
    """Nodes in heap order (children of i: 2i + 1, 2i + 2); feature -1 marks a leaf; bins up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    value: np.ndarray


class BoostedTrees(NamedTuple):
    features: list[str]
    starts: list[list[float]]  # per feature the lowest value of each bin but the first
    trees: list[list[Tree]]    # per round one per class

    @property
    def classes(self) -> int:
        return len(self.trees[0])


def _empty(depth: int) -> Tree:
    size = 2 ** (depth + 1) - 1
    return Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros(size))


def _walk(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Node in which each row (of bins) ends."""
    node = np.zeros(len(bins), int)
    rows = np.arange(len(bins))
    for _ in range(int(np.log2(len(tree.feature) + 1)) - 1):
        feature = tree.feature[node]
        right = bins[rows, feature] > tree.cut[node]  # feature -1 reads some column; the row stays anyway
        node = np.where(feature < 0, node, 2 * node + 1 + right)
    return node


def _margins(trees: list[list[Tree]], bins: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Margins ``total`` plus the trees, added round by round wherever the sum was broken off."""
    total = total.copy()
    for one_round in trees:
        for k, tree in enumerate(one_round):
            total[:, k] += tree.value[_walk(tree, bins)]
    return total


def _softmax(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


# -- bins ---------------------------------------------------------------------------

def _finite(column: Column) -> Column:
    """The value as a finite double; NaN is a gap and counts as 0, like the null values before."""
    largest = F.lit(float(np.finfo(float).max))
    return F.greatest(F.least(F.nanvl(column.cast("double"), F.lit(0.0)), largest), -largest)


def bin_starts(counted: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the lowest value of each bin but the first, from weighted counts of its values.

    Values are sorted by one range shuffle and their weights summed up across
    partitions; at most ``bins`` numbers per feature reach the driver.
    """
    with working_tables():
        pairs = F.explode(F.array(*[
            F.struct(F.lit(i).alias("feature"), _finite(F.col(f"`{c}`")).alias("value")) for i, c in enumerate(features)
        ]))
        values = materialise(
            counted.select(pairs.alias("p"), "weight").groupBy("p.feature", "p.value")
            .agg(F.sum("weight").alias("weight")), "values")
        sizes = {
            r["feature"]: r for r in values.groupBy("feature")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).collect()
        }
        few = [i for i in range(len(features)) if i in sizes and sizes[i]["n"] <= bins]
        starts: dict[int, list[float]] = {i: [] for i in range(len(features))}
        for r in values.where(F.col("feature").isin(few)).collect():
            starts[r["feature"]].append(r["value"])
        many = [i for i in sizes if i not in few]
        if many:
            summed = with_running_sum(values.where(F.col("feature").isin(many)), ["feature", "value"], "weight", "upto")
            before, total = 0.0, F.lit(None).cast("double")
            first = F.lit(None).cast("double")
            for i in sorted(many):  # running sums go on from feature to feature
                here = F.col("feature") == i
                total = F.when(here, sizes[i]["weight"]).otherwise(total)
                first = F.when(here, before).otherwise(first)
                before += sizes[i]["weight"]
            place = F.floor((F.col("upto") - F.col("weight") - first) * bins / total)
            for r in summed.groupBy("feature", place.alias("place")).agg(F.min("value").alias("value")).collect():
                starts[r["feature"]].append(r["value"])
    return [sorted(starts[i])[1:] for i in range(len(features))]


def _binned(counted: DataFrame, features: list[str], starts: list[list[float]], classes: int) -> DataFrame:
    """One row per combination of bins: ``bins`` and ``weights``, one per class."""
    splits = [[-np.inf, *s, np.inf] if s else [-np.inf, 0.0, np.inf] for s in starts]
    numbers = [f"_bin{i}" for i in range(len(features))]
    values = counted.select(
        *[_finite(F.col(f"`{c}`")).alias(f"_value{i}") for i, c in enumerate(features)], "label", "weight")
    placed = Bucketizer(
        splitsArray=splits, inputCols=[f"_value{i}" for i in range(len(features))], outputCols=numbers).transform(values)
    # a feature of one value has one bin
    bins = [F.col(n).cast("int") if s else F.lit(0) for n, s in zip(numbers, starts)]
    return placed.groupBy(F.array(*bins).alias("bins")).agg(F.array(*[
        F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0.0)) for k in range(classes)
    ]).alias("weights"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# -- growing --------------------------------------------------------------------------

def _histograms(
    pending: list[list[Tree]], growing: list[Tree], level: int, widths: list[int], scale: float, rewritten: bool
) -> Callable:
    """Rows (cell, g, h) of a task: sums per (class, node of the level, feature, bin), as whole numbers."""
    classes, n_features, width = len(growing), len(widths), max(widths)
    nodes, first = 2 ** level, 2 ** level - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = classes * nodes * n_features * width
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            bins, weights = _matrix(batch.column(0), n_features), _matrix(batch.column(1), classes)
            before = _matrix(batch.column(2), classes) if rewritten else np.zeros(weights.shape)
            shares = _softmax(_margins(pending, bins, before))
            rows = weights.sum(axis=1, keepdims=True)
            g = np.rint((rows * shares - weights) * scale).astype(np.int64)
            h = np.rint(rows * np.maximum(2 * shares * (1 - shares), _LEAST_HESSIAN) * scale).astype(np.int64)
            for k, tree in enumerate(growing):
                node = _walk(tree, bins) - first
                here = np.flatnonzero(node >= 0)  # rows that end in a leaf above are settled
                start = ((k * nodes + node[here])[:, None] * n_features + np.arange(n_features)) * width
                cells = (start + bins[here]).ravel()
                np.add.at(total[0], cells, np.repeat(g[here, k], n_features))
                np.add.at(total[1], cells, np.repeat(h[here, k], n_features))
        cells = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(total[0, cells]), pa.array(total[1, cells])], ["cell", "g", "h"])
    return run


def best_splits(g: np.ndarray, h: np.ndarray, penalty: float = PENALTY, least: float = MIN_HESSIAN):
    """(gain, feature, cut, sums left of the cut) of histograms (features, bins); feature -1 if nothing gains."""
    g_left, h_left = g.cumsum(axis=1), h.cumsum(axis=1)
    g_all, h_all = g_left[:1, -1:], h_left[:1, -1:]
    g_right, h_right = g_all - g_left, h_all - h_left
    gain = g_left ** 2 / (h_left + penalty) + g_right ** 2 / (h_right + penalty) - g_all ** 2 / (h_all + penalty)
    gain = np.where((h_left >= least) & (h_right >= least), gain, -np.inf)
    at = int(np.argmax(gain))
    feature, cut = divmod(at, g.shape[1])
    if not gain.flat[at] > MIN_GAIN:
        return 0.0, -1, 0, 0.0, 0.0
    return float(gain[feature, cut]), feature, cut, float(g_left[feature, cut]), float(h_left[feature, cut])


def _grow(
    table: DataFrame | pa.Table, pending: list[list[Tree]], classes: int, widths: list[int], depth: int, rate: float,
    scale: float, rewritten: bool,
) -> list[Tree]:
    """One tree per class."""
    trees = [_empty(depth) for _ in range(classes)]
    width, n_features = max(widths), len(widths)
    for level in range(depth):
        first, nodes = 2 ** level - 1, 2 ** level
        run = _histograms(pending, trees, level, widths, scale, rewritten)
        if isinstance(table, pa.Table):
            found = pa.Table.from_batches(run(iter(table.to_batches())))
        else:
            found = (
                table.mapInArrow(run, "cell bigint, g bigint, h bigint")
                .groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            )
        sums = np.zeros((2, classes * nodes * n_features * width))
        for i, name in enumerate(("g", "h")):
            sums[i, found["cell"].to_numpy()] = found[name].to_numpy() / scale
        g, h = sums.reshape(2, classes, nodes, n_features, width)
        grown = False
        for k, tree in enumerate(trees):
            for node in range(nodes):
                g_all, h_all = g[k, node, 0].sum(), h[k, node, 0].sum()
                if not h_all:
                    continue  # nothing reaches this node
                at = first + node
                if level == 0:
                    tree.value[at] = -rate * g_all / (h_all + PENALTY)
                gain, feature, cut, g_left, h_left = best_splits(g[k, node], h[k, node])
                if feature < 0:
                    continue
                grown = True
                tree.feature[at], tree.cut[at], tree.gain[at] = feature, cut, gain
                tree.value[2 * at + 1] = -rate * g_left / (h_left + PENALTY)
                tree.value[2 * at + 2] = -rate * (g_all - g_left) / (h_all - h_left + PENALTY)
        if not grown:
            break
    return trees


def _rescored(
    table: DataFrame | pa.Table, pending: list[list[Tree]], classes: int, n_features: int, rewritten: bool
) -> DataFrame | pa.Table:
    """The table with the margins of all trees so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = _matrix(batch.column(1), classes)
            before = _matrix(batch.column(2), classes) if rewritten else np.zeros(weights.shape)
            margins = _margins(pending, _matrix(batch.column(0), n_features), before)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(0, margins.size + 1, classes), pa.int32()), pa.array(margins.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["bins", "weights", "margins"])

    if isinstance(table, pa.Table):
        return pa.Table.from_batches(run(iter(table.to_batches())))
    return materialise(table.mapInArrow(run, "bins array<int>, weights array<double>, margins array<double>"), "margins")


def fit(
    counted: DataFrame, features: list[str], classes: int, depth: int, rounds: int = 100, rate: float = 0.1,
    bins: int = BINS,
) -> BoostedTrees:
    """Trees from (features as numbers, label 0 .. classes - 1, weight); labels and features are not null.

    At most ``CLASSES`` classes: histograms grow with them.
    """
    if not 0 < classes <= CLASSES:
        raise ValueError(f"{classes} classes; 1 to {CLASSES} can be learned")
    starts = bin_starts(counted, features, bins)
    widths = [len(s) + 1 for s in starts]
    trees: list[list[Tree]] = []
    with working_tables():
        table = materialise(_binned(counted, features, starts, classes), "bins")
        total = table.agg(F.sum(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w))).first()[0] or 1.0
        scale = 2.0 ** (61 - int(np.ceil(np.log2(total + 1))))  # sums stay below 2^62
        if table.count() <= LOCAL_ROWS:
            table = table.toArrow()
        rewrite = 1 if isinstance(table, pa.Table) else _REWRITE
        written = 0
        for done in range(rounds):
            if done - written == rewrite:
                table = _rescored(table, trees[written:], classes, len(features), written > 0)
                written = done
            trees.append(_grow(table, trees[written:], classes, widths, depth, rate, scale, written > 0))
    return BoostedTrees(features, starts, trees)


# -- using ----------------------------------------------------------------------------

def probabilities(model: BoostedTrees) -> Column:
    """Class probabilities of a row, from its feature columns.

    Equal rows of a batch are scored once.
    """
    starts, trees, classes = model.starts, model.trees, model.classes

    @F.pandas_udf("array<double>")
    def scored(*values: pd.Series) -> pd.Series:
        bins = np.column_stack([
            np.searchsorted(s, v.to_numpy(float), side="right") for s, v in zip(starts, values)])
        distinct, place = np.unique(bins, axis=0, return_inverse=True)
        shares = _softmax(_margins(trees, distinct, np.zeros((len(distinct), classes)))) if len(distinct) else distinct
        return pd.Series(list(shares[place.ravel()]), dtype=object)

    return scored(*[_finite(F.col(f"`{c}`")) for c in model.features])


def importances(model: BoostedTrees) -> list[float]:
    """Mean gain of the splits of each feature, scaled to sum 1; all 0 without splits."""
    total, splits = np.zeros(len(model.features)), np.zeros(len(model.features))
    for one_round in model.trees:
        for tree in one_round:
            used = tree.feature >= 0
            np.add.at(total, tree.feature[used], tree.gain[used])
            np.add.at(splits, tree.feature[used], 1)
    mean = total / np.maximum(splits, 1)
    return (mean / mean.sum() if mean.sum() else mean).tolist()


def save(model: BoostedTrees, spark: SparkSession, path: str) -> None:
    rows = [
        (r, k, i, int(t.feature[i]), int(t.cut[i]), float(t.gain[i]), float(t.value[i]))
        for r, one_round in enumerate(model.trees) for k, t in enumerate(one_round)
        for i in range(len(t.feature)) if i == 0 or t.feature[(i - 1) // 2] >= 0
    ]
    depth = int(np.log2(len(model.trees[0][0].feature) + 1)) - 1
    spark.createDataFrame(rows, _TREE_DDL).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame(
        [(model.features, model.starts, model.classes, depth)],
        "features ARRAY<STRING>, starts ARRAY<ARRAY<DOUBLE>>, classes INT, depth INT",
    ).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> BoostedTrees:
    about = spark.read.parquet(f"{path}/about").first()
    rows = spark.read.parquet(f"{path}/trees").collect()
    trees = [
        [_empty(about["depth"]) for _ in range(about["classes"])] for _ in range(1 + max(r["round"] for r in rows))]
    for r in rows:
        tree, i = trees[r["round"]][r["class"]], r["node"]
        tree.feature[i], tree.cut[i], tree.gain[i], tree.value[i] = r["feature"], r["cut"], r["gain"], r["value"]
    return BoostedTrees(list(about["features"]), [list(s) for s in about["starts"]], trees)
