"""Embedding whitening: leading components of the covariance by contour integration.

Entries become integers, x = floor(1024 c) + 100000, so sums and products add
up exactly whatever the order of the tasks. One pass gives the sums, a second
the products of the entries centred on the integers nearest to the means; what
remains of the centring, at most one half per entry, comes off exactly. The
covariance has dims x dims numbers, whatever the number of rows.

Its largest eigenvalues are found by FEAST. Inertia counts (positive pivots of
V - s) cut the spectrum from the top into slices of few eigenvalues. Per slice,
a random block is projected onto the eigenvectors of the slice by quadrature of
(z - V)^-1 Y over a circle of complex shifts, Rayleigh-Ritz picks eigenpairs
out of the projection, and both repeat until the residuals vanish and as many
eigenvalues lie in the slice as inertia says. Shifts are counted, and shifted
systems solved, in Spark tasks: one row per shift.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.session import materialise, working_tables

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000  # x = floor(SCALE * c) + SHIFT
SLICE_VALUES = 8  # eigenvalues searched for in one slice
SECTIONS = 16  # parts that one round of counting cuts a slice into
NODES = 8  # quadrature points of the upper half circle
_LARGEST = 2.0 ** 50  # x is taken no further from SHIFT than this, so that products fit
_EXACT_ROWS, _EXACT_SIZE = 4096, 2.0 ** 20  # products of such blocks add up exactly in doubles
_TOLERANCE = 1e-14  # residual of a unit eigenvector, relative to the trace
_SEED = 11


class Fit(NamedTuple):
    """Mean of x, eigenvalues (falling), unit eigenvectors as columns and trace of the covariance of x."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose vector is not null and holds finite entries only."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(finite).select("vec_id", "embedding")


def _entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row places, x - SHIFT as doubles) per vector length in the batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for dims in np.unique(sizes[sizes > 0]):
        places = np.flatnonzero(sizes == dims)
        rows = flat[starts[places][:, None] + np.arange(dims)]
        yield places, np.clip(np.floor(SCALE * rows), -_LARGEST, _LARGEST)


def _decimals(values) -> pa.Array:
    """Whole numbers as decimal(38, 0); null beyond."""
    if isinstance(values, np.ndarray) and values.dtype == np.int64:
        return pa.array(values).cast(pa.decimal128(19, 0)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(v)) if abs(v) < 10 ** 38 else None for v in values], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dims, place, v): the sum of x - SHIFT per place, and the number of vectors at place -1."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, rows in _entries(batch.column(0)):
            dims = rows.shape[1]
            whole = rows.astype(np.int64)
            mine = whole.sum(axis=0) if np.abs(rows).max() < 2.0 ** 40 else whole.astype(object).sum(axis=0)
            total = totals.setdefault(dims, np.zeros(dims + 1, object))
            total += np.append(mine.astype(object), len(rows))
    for dims, total in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dims] * (dims + 1), pa.int32()), pa.array([*range(dims), -1], pa.int32()), _decimals(total)],
            ["dims", "place", "v"])


def _products(centre: np.ndarray) -> Callable:
    """Rows (a, b, v), a <= b: the sum over the vectors of the products of their centred entries."""
    dims = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        part, parts = np.zeros((dims, dims), np.int64), 0
        for batch in batches:
            for _, rows in _entries(batch.column(0)):
                rows = rows - centre
                small = np.abs(rows).max(axis=1) <= _EXACT_SIZE
                for row in rows[~small].astype(np.int64).astype(object):
                    total += np.outer(row, row)
                rows = rows[small]
                for i in range(0, len(rows), _EXACT_ROWS):
                    block = rows[i:i + _EXACT_ROWS]
                    part += (block.T @ block).astype(np.int64)
                    parts += 1
                    if parts == 1024:  # each block adds less than 2 ** 53
                        total += part.astype(object)
                        part[:], parts = 0, 0
        total += part.astype(object)
        a, b = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), _decimals(total[a, b])], ["a", "b", "v"])
    return run


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x over vectors of one length, divisor n, each entry rounded once."""
    dims = len(sums)
    centre = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]  # n times the mean of the centred entries
    found = (
        vectors.select("embedding").mapInArrow(_products(np.array(centre, float)), "a int, b int, v decimal(38,0)")
        .groupBy("a", "b").agg(F.sum("v").alias("v")).collect()
    )
    v = np.zeros((dims, dims))
    for a, b, total in found:
        v[a, b] = v[b, a] = (n * int(total) - rest[a] * rest[b]) / (n * n)
    return v


def _above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``v`` above ``shift``: positive pivots of v - shift, factored with 1x1 and 2x2 pivots."""
    a = v - shift * np.eye(len(v))
    above = 0
    while len(a):
        size = np.abs(a)
        i = int(np.argmax(np.diag(size)))
        p, q = np.unravel_index(int(np.argmax(size)), a.shape)
        if size[p, q] == 0:
            break
        if size[i, i] >= 0.64 * size[p, q]:  # the usual bound on growth: (1 + sqrt(17)) / 8
            above += a[i, i] > 0
            block = [i]
        else:  # a 2x2 pivot of negative determinant has one eigenvalue of each sign
            above += 1
            block = [p, q]
        rest = np.delete(np.arange(len(a)), block)
        side = a[np.ix_(rest, block)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(block, block)], side.T)
        a = (a + a.T) / 2
    return above


def _counts(spark: SparkSession, shared, shifts: list[float]) -> list[int]:
    """Eigenvalues above each shift, one task per shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_above(shared.value, s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["at", "n"])

    rows = spark.createDataFrame(list(enumerate(shifts)), "at int, shift double").repartition(len(shifts), "at")
    found = dict(rows.mapInArrow(run, "at int, n bigint").collect())
    return [found[i] for i in range(len(shifts))]


def _slices(spark: SparkSession, shared, wanted: int, floor: float) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) from the top of the spectrum down until ``wanted`` are covered.

    ``shared`` holds a matrix of trace 1. A slice holds at most ``SLICE_VALUES``
    eigenvalues unless they agree to twelve digits. Eigenvalues up to ``floor``
    count as zero and are left out.
    """
    top = 1 + 1e-9
    edges = {top: 0, floor: _counts(spark, shared, [floor])[0]}
    while True:
        order = sorted(edges, reverse=True)
        wide = [
            (low, high) for high, low in zip(order, order[1:])
            if edges[high] < wanted and edges[low] - edges[high] > SLICE_VALUES and high - low > 1e-12 * top
        ]
        if not wide:
            break
        shifts = [low + (high - low) * i / SECTIONS for low, high in wide for i in range(1, SECTIONS)]
        edges |= dict(zip(shifts, _counts(spark, shared, shifts)))
    found = [(low, high, edges[low] - edges[high]) for high, low in zip(order, order[1:]) if edges[high] < wanted]
    return [s for s in found if s[2]]


def _solve(shared, blocks) -> Callable:
    nodes, weights = np.polynomial.legendre.leggauss(NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for at, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high, y = blocks.value[at]
                turn = (high - low) / 2 * np.exp(1j * np.pi / 2 * (1 - nodes[node]))
                solved = np.linalg.solve(((low + high) / 2 + turn) * np.eye(len(v)) - v, y.astype(complex))
                part = np.real(turn * solved) * weights[node] / 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), pa.array([node], pa.int32()), pa.array([part.tobytes()])],
                    ["slice", "node", "part"])
    return run


def _ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling Ritz values of ``v`` in the span of ``block``, and their unit vectors."""
    basis = np.linalg.qr(block)[0]
    values, turned = np.linalg.eigh(basis.T @ v @ basis)
    return values[::-1], basis @ turned[:, ::-1]


def leading(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns.

    Fewer if fewer are above zero (dims times the rounding of the trace).
    """
    dims, trace = len(v), float(np.trace(v))
    if not wanted or not trace > 0:
        return np.zeros(0), np.zeros((dims, 0))
    v = v / trace
    shared = spark.sparkContext.broadcast(v)
    slices = _slices(spark, shared, wanted, dims * float(np.finfo(float).eps))
    rng = np.random.default_rng(_SEED)
    blocks = {
        i: rng.standard_normal((dims, min(dims, max(2 * n, n + 6)))) for i, (_, _, n) in enumerate(slices)
    }
    found: dict[int, np.ndarray] = {}
    before = dict.fromkeys(blocks, np.inf)
    while len(found) < len(slices):
        left = [i for i in blocks if i not in found]
        sent = spark.sparkContext.broadcast({i: (*slices[i][:2], blocks[i]) for i in left})
        rows = spark.createDataFrame([(i, e) for i in left for e in range(NODES)], "slice int, node int")
        solved = rows.repartition(len(left) * NODES, "slice", "node").mapInArrow(
            _solve(shared, sent), "slice int, node int, part binary").collect()
        parts = {(i, e): np.frombuffer(part).reshape(dims, -1) for i, e, part in solved}
        sent.destroy()
        for i in left:
            low, high, n = slices[i]
            block = sum(parts[i, e] for e in range(NODES))
            if block.shape[1] == dims:  # the whole space: nothing to project onto
                block = np.eye(dims)
            values, ritz = _ritz(v, block)
            inside = (values > low) & (values <= high)
            residual = np.linalg.norm(v @ ritz - ritz * values, axis=0)[inside].max(initial=0)
            if block.shape[1] == dims or (inside.sum() == n and residual <= _TOLERANCE):
                found[i] = ritz[:, inside] if inside.sum() == n else ritz
            elif inside.sum() == n and residual < before[i] / 4:
                blocks[i], before[i] = ritz, residual
            elif inside.sum() == n and residual <= 10 * _TOLERANCE:  # as far as rounding lets it fall
                found[i] = ritz[:, inside]
            else:  # too many eigenvalues close by: widen the block
                more = min(dims, 2 * ritz.shape[1]) - ritz.shape[1]
                blocks[i] = np.hstack([ritz, rng.standard_normal((dims, more))])
                before[i] = np.inf
    shared.destroy()
    # vectors of neighbouring slices become orthogonal, whatever the gap between them
    values, vectors = _ritz(v, np.hstack([found[i] for i in sorted(found)]))
    kept = min(wanted, sum(n for _, _, n in slices))
    return values[:kept] * trace, vectors[:, :kept] * np.where(
        np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], 0)[:, :kept] < 0, -1.0, 1.0)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of the vectors of each length over all of them; ``vectors`` as from ``usable``."""
    spark = vectors.sparkSession
    rows = (
        vectors.select("embedding").mapInArrow(_sums, "dims int, place int, v decimal(38,0)")
        .groupBy("dims", "place").agg(F.sum("v").alias("v")).collect()
    )
    totals: dict[int, dict[int, int]] = {}
    for dims, place, v in rows:
        totals.setdefault(dims, {})[place] = int(v)
    fits = {}
    for dims, total in sorted(totals.items()):
        n, sums = total[-1], [total[i] for i in range(dims)]
        v = covariance(vectors.where(F.size("embedding") == dims), n, sums)
        values, found = leading(spark, v, min(components, dims))
        fits[dims] = Fit(n, [s + n * SHIFT for s in sums], values, found, float(np.trace(v)))
    return fits


def _project(model: Fit, width: int) -> Callable:
    """Rows (vec_id, deviation, w): the whitened components, null where the variance is zero."""
    n, dims = model.n, len(model.sums)
    sums = [s - n * SHIFT for s in model.sums]
    centre = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    mean = np.array([float(Fraction(r, n)) for r in rest])
    turn = model.vectors / np.sqrt(model.values)
    whole = np.array(rest, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, rows in _entries(batch.column(1)):
                rows = rows - np.array(centre, float)
                white = np.full((len(rows), width), np.nan)
                white[:, :turn.shape[1]] = (rows - mean) @ turn
                if (n * np.abs(rows).max() + n) ** 2 * dims < 2.0 ** 62:
                    off = n * rows.astype(np.int64) - whole.astype(np.int64)
                    deviation = (off * off).sum(axis=1)
                else:
                    off = n * rows.astype(np.int64).astype(object) - whole
                    deviation = (off * off).sum(axis=1)
                flat = white.ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(places)), _decimals(deviation),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(0, len(flat) + 1, width), pa.int32()),
                         pa.array(flat, pa.float64(), mask=np.isnan(flat)))],
                    ["vec_id", "deviation", "w"])
    return run


def _identity_error(white: DataFrame, found: int) -> float | None:
    """Largest absolute entry of the covariance of the first ``found`` whitened components minus the identity."""
    pairs = [(a, b) for a in range(found) for b in range(a + 1)]
    if not pairs:
        return None
    row = white.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return float(max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component.

    Columns: vec_id, component (from 1, at most ``components`` and the length
    of the vector), n (vectors of the fit), deviation (decimal(38, 0): the sum
    over dimensions of (n x - S)^2, null beyond 38 digits), whitened,
    explained, identity_error.

    Vectors that are null or hold null or non-finite entries give no rows, nor
    do empty vectors or an empty table. Vectors of each length are a table of
    their own with their own fit. Rows with equal or null vec_id are kept each.
    A component without variance has whitened null and explained 0 (null if
    the whole table has none), and the identity covers only the others. Entries
    beyond 2^40 count as 2^40. Other columns are not read.
    """
    rows = usable(vectors)
    kind = rows.schema["vec_id"].dataType.simpleString()
    empty = rows.sparkSession.createDataFrame(
        [], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, "
            "explained double, identity_error double")
    with working_tables() as keep:
        parts = []
        for dims, model in fit(rows, components).items():
            width = min(components, dims)
            white = materialise(
                rows.where(F.size("embedding") == dims).mapInArrow(
                    _project(model, width), f"vec_id {kind}, deviation decimal(38,0), w array<double>"),
                "white")
            keep.append(white)
            parts.append(white.select(
                "vec_id", "deviation", F.posexplode("w").alias("place", "whitened"),
            ).select(
                "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
                "whitened", F.get(F.lit(_explained(model, width)).cast("array<double>"), F.col("place")).alias("explained"),
                F.lit(_identity_error(white, len(model.values))).cast("double").alias("identity_error")))
    for part in parts:
        empty = empty.unionByName(part) if empty is not None else part
    return empty


def _explained(model: Fit, width: int) -> list[float | None]:
    if not model.trace > 0:
        return [None] * width
    return [*(model.values / model.trace).tolist(), *[0.0] * (width - len(model.values))]
