"""Connected components of a graph given as an edge table of two 64-bit ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.joins import SPLIT_ROWS, skew_join
from kerbside.session import materialise


def _relabel(edges: DataFrame, roots: DataFrame, split_rows: int, n_edges: int) -> DataFrame:
    """Replace both ends by their roots; drop loops and repeats."""
    for end in ("a", "b"):
        table = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        edges = skew_join(edges, table, [end], split_rows=split_rows, left_rows=n_edges)
    low, high = F.col("a_root"), F.col("b_root")
    return (
        edges.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b"))
        .where("a <> b").distinct()
    )


def connected_components(edges: DataFrame, split_rows: int = SPLIT_ROWS, stars: bool = False) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, which should be a written table.

    The graph is contracted round by round: every node joins its neighbour (or
    itself) of lowest rank, and edges inside a joined node disappear. The rank
    is a fresh hash, which shrinks a graph of any shape by a constant factor;
    with ``stars`` the first round ranks by id, which folds stars around their
    smallest id at once. No node gathers its neighbours into one task. The root is
    some node of the component, the same for all of its nodes.
    """
    edges = edges.select("a", "b")
    merges: list[DataFrame] = []
    rest, n_rest, turn = edges, edges.count(), 0 if stars else 1
    while n_rest:
        ends = rest.unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.least(F.min(_ranked("b", turn)), F.min(_ranked("a", turn)))
        roots = materialise(
            ends.groupBy(F.col("a").alias("node")).agg(best["id"].alias("root")), "roots"
        )
        merges.append(roots)
        rest = materialise(_relabel(rest, roots, split_rows, n_rest), "edges")
        n_rest = rest.count()
        turn += 1

    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = labels.withColumn("root", F.col("node"))
    for i, roots in enumerate(merges):
        step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = skew_join(
            labels, step, ["root"], "left", split_rows=split_rows,
            left_rows=0 if i == 0 else None,  # before the first merge every root is its own node
        ).select("node", F.coalesce("next", "root").alias("root"))
        if 0 < i < len(merges) - 1:
            labels = materialise(labels, "labels")
    return labels


def _ranked(column: str, turn: int) -> Column:
    rank = F.xxhash64(F.col(column), F.lit(turn)) if turn else F.col(column)
    return F.struct(rank.alias("h"), F.col(column).alias("id"))
