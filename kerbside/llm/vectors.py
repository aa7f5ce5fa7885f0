"""Embedding near-duplicates by a bound over a subspace.

Unit vectors are turned by a fixed random rotation, which spreads their
variance over all directions, and compared over the first few of them: their
product there, plus the product of the lengths of what is left of both, is
never below their cosine. So few directions rule out nearly every unrelated
pair, and no pair in reach is missed. Where a tile keeps many pairs, all
directions are looked at; what then remains is verified on whole vectors in
double precision.

Equal vectors are merged first. The others are packed into chunks of a bounded
number of vectors, one row each, and every two chunks meet in a nested loop
over the written table: its tasks read the table where it lies, so no vector is
copied into a shuffle however many chunks there are. A task hands on link counts
and spanning links, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import small_batches, spanning_links
from kerbside.operators.components import connected_components
from kerbside.operators.joins import skew_join
from kerbside.session import materialise, working_tables

MIN_COSINE = 0.9
HOME_ROWS = 4096
_CHUNK_BYTES = 4 << 20
_TILE_ROWS = 512
_VERIFIED_PAIRS = 50_000
# Counts and links that a task gathers before it hands them on.
_GATHERED = 1_000_000
_SEED = 20


@lru_cache(maxsize=1)
def _rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dims, dims)))[0]


def _leading(dims: int, min_cosine: float) -> int:
    """Directions over which all but about one in 10 000 unrelated pairs are already too far apart."""
    m = np.arange(1, dims)
    least = 2 * m / dims * np.maximum(0, 1 - 2 / (9 * m) - 3.7 * np.sqrt(2 / (9 * m))) ** 3
    enough = np.flatnonzero(least >= 2 - 2 * min_cosine)
    return int(m[enough[0]]) if len(enough) else dims


def _packed(distinct: DataFrame, home_rows: int) -> DataFrame:
    """Chunks of vectors of one length, a row each: lists of their id, n, first, k1 and k2, and one block of bytes."""
    single = isinstance(distinct.schema["embedding"].dataType.elementType, T.FloatType)
    kind = np.dtype(np.float32 if single else np.float64)
    lists = ["id", "n", "first", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunks: dict[int, list] = {}
        held = 0

        def close(dims: int) -> pa.RecordBatch:
            parts = open_chunks.pop(dims)
            columns = [pa.concat_arrays([p[i] for p in parts]) for i in range(len(lists))]
            ends = pa.array([0, len(columns[0])], pa.int32())
            return pa.RecordBatch.from_arrays(
                [columns[0][:1], pa.array([dims], pa.int32()), *(pa.ListArray.from_arrays(ends, c) for c in columns),
                 pa.array([b"".join(p[-1] for p in parts)], pa.binary())],
                ["chunk", "dims", *lists, "vec"])

        for batch in batches:
            vectors = batch.column(len(lists))
            lengths = np.diff(vectors.offsets.to_numpy())
            for dims in np.unique(lengths).tolist():
                most = max(1, min(home_rows, _CHUNK_BYTES // (dims * kind.itemsize)))
                places = np.flatnonzero(lengths == dims)
                while len(places):
                    room = most - sum(len(p[0]) for p in open_chunks.get(dims, []))
                    taken, places = pa.array(places[:room]), places[room:]
                    values = vectors.take(taken).flatten().to_numpy(zero_copy_only=False).astype(kind)
                    held += values.nbytes
                    open_chunks.setdefault(dims, []).append(
                        [*(batch.column(i).take(taken) for i in range(len(lists))), values.tobytes()])
                    if len(taken) == room:
                        held -= sum(len(p[-1]) for p in open_chunks[dims])
                        yield close(dims)
            if held > 16 * _CHUNK_BYTES:  # vectors of very many lengths
                yield from [close(dims) for dims in list(open_chunks)]
                held = 0
        yield from [close(dims) for dims in list(open_chunks)]

    first = distinct.schema["first"].dataType.simpleString()
    return small_batches(distinct.select(*lists, "embedding")).mapInArrow(
        run, "chunk bigint, dims int, id array<bigint>, n array<bigint>, "
             f"first array<{first}>, k1 array<bigint>, k2 array<bigint>, vec binary")


def _links(min_cosine: float, single: bool):
    """Link counts (a, null, n) and spanning links (a, b, 0) of the chunks that meet in a partition."""
    def opened(batch: pa.RecordBatch, row: int, at: int) -> dict:
        dims, ids, n, vec = (batch.column(at + i)[row] for i in range(1, 5))
        dims = dims.as_py()
        values = np.frombuffer(vec.as_buffer(), np.float32 if single else np.float64).reshape(-1, dims).astype(np.float64)
        # a power of two brings the largest component near 1, so that no square over- or underflows
        values = np.ldexp(values, -np.frexp(np.abs(values).max(axis=1))[1][:, None])
        turned = (values / np.linalg.norm(values, axis=1, keepdims=True)) @ _rotation(dims)
        leading = _leading(dims, min_cosine)
        rest = np.sqrt((turned[:, leading:] ** 2).sum(axis=1, keepdims=True))
        return {
            "chunk": batch.column(at)[row].as_py(), "ids": ids.values.to_numpy(), "n": n.values.to_numpy(), "values": values,
            "turned": turned.astype(np.float32), "bound": np.concatenate([turned[:, :leading], rest], axis=1).astype(np.float32),
        }

    def met(home: dict, guests: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (guest, home) of the pairs that may be in reach: a few more than are."""
        own, dims = home["chunk"] == guests["chunk"], home["values"].shape[1]
        # what sums of single precision can be off
        floor = np.float32(min_cosine - (dims + 8) * 2.0**-23)
        found, held = [], 0
        for a in range(0, len(guests["ids"]), _TILE_ROWS):
            for b in range(0, min(len(home["ids"]), a + _TILE_ROWS) if own else len(home["ids"]), _TILE_ROWS):
                tile, against = slice(a, a + _TILE_ROWS), slice(b, b + _TILE_ROWS)
                product = guests["bound"][tile] @ home["bound"][against].T
                rows = np.flatnonzero(product.max(axis=1) >= floor)
                near = np.flatnonzero(product[rows] >= floor)
                if len(near) > product.size // 50:
                    near = np.flatnonzero(guests["turned"][tile][rows] @ home["turned"][against].T >= floor)
                g, h = np.divmod(near, product.shape[1])
                g = rows[g]
                g, h = g + a, h + b
                found.append((g[g > h], h[g > h]) if own else (g, h))
                held += len(found[-1][0])
                if held > _VERIFIED_PAIRS:
                    yield from in_parts(found)
                    found, held = [], 0
        yield from in_parts(found)

    def in_parts(found: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        g, h = (np.concatenate(x) for x in zip(*found)) if found else ([], [])
        for k in range(0, len(g), _VERIFIED_PAIRS):
            yield g[k:k + _VERIFIED_PAIRS], h[k:k + _VERIFIED_PAIRS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, counts, links = {"chunk": None}, [], []

        def handed_on() -> Iterator[pa.RecordBatch]:
            if counts:
                ids, n = (np.concatenate(x) for x in zip(*counts))
                ids, place = np.unique(ids, return_inverse=True)
                total = np.zeros(len(ids), np.int64)
                np.add.at(total, place, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(total)], ["a", "b", "n"])
                a, b = spanning_links(*(np.concatenate(x) for x in zip(*links)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "n"])
            counts.clear()
            links.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(0)[row].as_py() != home["chunk"]:
                    home = opened(batch, row, 0)
                guests = home if batch.column(5)[row].as_py() == home["chunk"] else opened(batch, row, 5)
                for g, h in met(home, guests):
                    x, y = guests["values"][g], home["values"][h]
                    cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                    g, h = g[cosine >= min_cosine], h[cosine >= min_cosine]
                    if len(g):
                        a, b = guests["ids"][g], home["ids"][h]
                        links.append(spanning_links(a, b))
                        for left, weight in ((a, home["n"][h]), (b, guests["n"][g])):
                            found, place = np.unique(left, return_inverse=True)
                            total = np.zeros(len(found), np.int64)
                            np.add.at(total, place, weight)
                            counts.append((found, total))
                if sum(len(x) for x, _ in counts) > _GATHERED:
                    yield from handed_on()
        yield from handed_on()
    return run


def near_links(packed: DataFrame, min_cosine: float, single: bool) -> DataFrame:
    """(a, b, n) for packed chunks of distinct vectors, in a written table; written.

    Rows without ``b`` add up to the number of vectors linked to ``a``, each
    weighted by its ``n``; the others are spanning links.
    """
    carried = ["chunk", "dims", "id", "n", "vec"]
    homes = packed.select(*[F.col(c).alias(f"home_{c}") for c in carried])
    # read side by side for every two partitions, not shuffled by length
    pairs = homes.join(packed.select(*carried).hint("shuffle_replicate_nl"), F.expr("home_dims = dims AND home_chunk <= chunk"))
    conf, key = packed.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, "4")  # rows of two chunks each
    try:
        return materialise(pairs.mapInArrow(_links(min_cosine, single), "a bigint, b bigint, n bigint"), "vector-links")
    finally:
        conf.set(key, before)


def components(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, home_rows: int = HOME_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row with vec_id and embedding.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, and vectors of different lengths never link. Equal
    vectors, repeated rows included, link with each other. ``component_id`` is
    the smallest vec_id reachable, a null vec_id never names a component with
    others. Labels and other columns are ignored; an empty table gives no rows.

    Rows find their vector again by two independent 64-bit hashes of it, so
    that the vectors themselves are shuffled once, to merge equal ones.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    values = F.col("embedding").cast("array<float>" if single else "array<double>")
    proper = (
        F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    hashes = [F.xxhash64(F.lit(seed), "embedding").alias(k) for seed, k in ((1, "k1"), (2, "k2"))]
    rows = vectors.select("vec_id", values.alias("embedding")).withColumn("proper", F.coalesce(proper, F.lit(False)))
    with working_tables() as keep:
        distinct = (
            rows.where("proper").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
            .select(F.monotonically_increasing_id().alias("id"), "n", "first", *hashes, "embedding")
        )
        packed = materialise(_packed(distinct, home_rows), "packed")
        found = near_links(packed, min_cosine, single)
        known = packed.select(F.explode(F.arrays_zip("id", "n", "first", "k1", "k2")).alias("row")).select("row.*")
        counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
        links = materialise(found.where("b IS NOT NULL").select("a", "b").distinct(), "links")
        roots = materialise(connected_components(links, stars=True), "roots").withColumnRenamed("node", "id")
        lowest = known.join(roots, "id").groupBy("root").agg(F.min("first").alias("component_id"))
        named = materialise(
            known.join(counts, "id", "left").join(roots, "id", "left").join(lowest, "root", "left")
            .select("k1", "k2", "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                    F.coalesce("component_id", "first").alias("component_id")),
            "named",
        )
        result = skew_join(
            rows.where("proper").select("vec_id", *hashes), named.drop("n"), ["k1", "k2"],
            counts=named.select("k1", "k2", F.col("n").alias("rows")),
        ).select("vec_id", "n_links", "component_id")
        alone = rows.where("NOT proper").select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        result = materialise(result.unionByName(alone), "vector-components")
        keep.append(result)
    return result.select(
        "vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))
