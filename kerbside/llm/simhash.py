"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit
segments. The Manhattan distance of two such vectors never exceeds the number
of differing bits, so fingerprints within ``max_bits`` lie within that
Manhattan distance. The range join under it is exact: the segments are cut
into blocks, a distance of at most 4 leaves all but 4 blocks at distance 0,
and so two fingerprints meet in the grid cell of some choice of the remaining
blocks. What meets in a cell is verified on all 64 bits.

Equal fingerprints are merged before anything else. Cells beyond
``CELL_ROWS`` are cut into chunks and compared chunk against chunk in separate
tasks. A task hands on spanning links only, at most one per fingerprint, never
the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import numbered, restored, small_batches, spanning_links
from kerbside.operators.components import connected_components
from kerbside.operators.joins import BROADCAST_ROWS, skew_join
from kerbside.session import materialise, working_tables

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
CELL_ROWS = 8192
_PENDING_LINKS = 500_000


def _fingerprint(text: bytes | None, size: int) -> bytes:
    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    hashes = b"".join([
        digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    ])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    counts = bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(bits)).tobytes()


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) with the SimHash of the 64-bit hashes of word shingles as a signed long.

    Words are separated by ASCII white space, A-Z count as a-z, repeated
    shingles count each time, a text of fewer words is one shingle. A null
    text and a text without words have the fingerprint zero.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = b"".join([_fingerprint(t.as_py(), shingle_words) for t in batch.column(1)])
            values = np.frombuffer(prints, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    texts = small_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _masks(blocks: int, open_blocks: int) -> list[int]:
    """Signed 64-bit masks of the segments in every choice of ``blocks - open_blocks`` blocks."""
    edges = [2 * (32 * i // blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - open_blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _blocks_for(n: int, max_bits: int) -> int:
    """Fewest blocks for which about 256 unrelated fingerprints meet a fingerprint in its cells.

    Two random segments have equal counts with probability 3/8.
    """
    for blocks in range(max_bits + 1, 17):
        if n * comb(blocks, max_bits) * 0.375 ** (32 * (blocks - max_bits) / blocks) <= 256:
            break
    return blocks


def _links_in_cells(max_bits: int):
    """Spanning links among the fingerprints of equal (grid, cell, part), rows sorted by those."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pending = 0

        def compare(rows: np.ndarray) -> None:
            nonlocal pending
            same = (rows[1:, :3] == rows[:-1, :3]).all(axis=1)
            cell = np.concatenate([[0], np.cumsum(~same)])
            fp, at, lag = rows[:, 3], np.arange(len(rows)), 1
            while True:
                at = at[at + lag < len(rows)]
                at = at[cell[at] == cell[at + lag]]
                if not len(at):
                    return
                near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= max_bits]
                if len(near):
                    found.append((fp[near], fp[near + lag]))
                    pending += len(near)
                    if pending > _PENDING_LINKS:
                        shrink()
                lag += 1

        def shrink() -> None:
            nonlocal pending
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                links = spanning_links(a.view(np.int64), b.view(np.int64))
                found[:] = [(links[0].view(np.uint64), links[1].view(np.uint64))]
                pending = len(links[0]) // 2  # what is left is needed; let new links double it

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns], axis=1)
            if rest is not None:
                rows = np.concatenate([rest, rows])
            if not len(rows):
                continue
            last = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            tail = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
            compare(rows[:tail]) if tail else None
            rest = rows[tail:]
        if rest is not None and len(rest):
            compare(rest)
        shrink()
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    return run


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) links that connect the distinct fingerprints ``fp`` within ``max_bits`` bits; written.

    Every pair of fingerprints within the distance is connected through the
    links; a pair itself is listed only if it is part of a spanning forest.
    """
    prints = prints.select("fp")
    fp, shifted = F.col("fp"), F.shiftleft("fp", 1)
    # counts of two-bit segments, packed in place: 00 -> 0, 01 and 10 -> 1, 11 -> 2
    counts = (fp.bitwiseAND(shifted).bitwiseAND(F.lit(-0x5555555555555556))).bitwiseOR(
        fp.bitwiseXOR(F.shiftrightunsigned("fp", 1)).bitwiseAND(F.lit(0x5555555555555555)))
    masks = _masks(_blocks_for(prints.count(), max_bits), max_bits)
    grids = F.explode(F.array(*[
        F.struct(F.lit(i).alias("grid"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell"))
        for i, m in enumerate(masks)
    ]))
    cells = prints.withColumn("counts", counts).select("fp", grids.alias("at")).select("at.grid", "at.cell", "fp")
    crowded = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
    crowded = materialise(crowded.withColumn("chunks", F.ceil(F.col("n") / (cell_rows // 2)).cast("int")), "crowded")
    if crowded.isEmpty():
        parted = cells.withColumn("part", F.lit(0).cast("long"))
    else:
        # every chunk meets every chunk (itself included) in a part of its own
        mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("long")
        other = F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)
        part = F.transform(other, lambda o: F.least(o, F.col("mine")) * F.col("chunks") + F.greatest(o, F.col("mine")))
        parted = (
            cells.join(crowded.select("grid", "cell", "chunks"), ["grid", "cell"], "left")
            .withColumn("mine", mine)
            .withColumn("part", F.explode(F.coalesce(F.array_distinct(part), F.array(F.lit(0).cast("long")))))
        )
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        parted.select("grid", "cell", "part", "fp").repartition(parts, "grid", "cell", "part")
        .sortWithinPartitions("grid", "cell", "part")
    )
    return materialise(ordered.mapInArrow(_links_in_cells(max_bits), "a bigint, b bigint").distinct(), "links")


def components(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of fingerprints.

    Null texts have fingerprint zero and are linked like any other. Rows with
    equal doc_id are kept; a null doc_id never names a component unless all of
    its documents lack one. An empty table gives an empty result.
    """
    with working_tables() as keep:
        prints = materialise(fingerprints(docs, shingle_words), "prints")
        distinct = materialise(
            prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
        links = near_links(distinct, max_bits, cell_rows)
        roots = materialise(connected_components(links, stars=True), "roots").withColumnRenamed("node", "fp")
        linked = distinct.join(roots, "fp").select("fp", "root", "first")
        lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
        named = linked.join(lowest, "root").select("fp", "component_id")
        # fingerprints of several documents, and linked ones; any other document is its own component
        copied = distinct.where("n > 1").join(roots, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
        found = materialise(named.unionByName(copied), "named")
        result = materialise(
            skew_join(prints, found, ["fp"], "left")
            .select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id")),
            "components",
        )
        keep.append(result)
    return result


def _numbered_rows(docs: DataFrame) -> DataFrame:
    """The numbered columns and ``number``, an ordered value of its own per row.

    Rows of Parquet files are known by file and place, without a copy. Tables
    that are not read from such files, or repeat their rows, are written once.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        rows = docs.select(place.alias("number"), *numbered(docs.columns))
        if rows.groupBy("number").count().where("count > 1").isEmpty():
            return rows
    except AnalysisException:  # no files below
        pass
    return materialise(
        docs.select(F.monotonically_increasing_id().alias("number"), *numbered(docs.columns)), "rows")


def deduplicate(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per component: that with the smallest doc_id, of several such rows the first by file and place.

    Rows are told apart by a number of their own, so neither a missing nor a
    repeated doc_id matters; a row without doc_id stays only if all of its
    component lack one. What is written beside the numbers of the rows that go
    is deleted at once; a table that is not read from Parquet stays as a copy.
    """
    place = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = _numbered_rows(docs)
    doc_id, text = (F.col(f"_kept_{i}") for i in place)
    key = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), F.col("number"))
    nullable = (
        f"struct<none:boolean,id:{docs.schema['doc_id'].dataType.simpleString()},"
        f"number:{rows.schema['number'].dataType.simpleString()}>")
    with working_tables() as keep:
        named = components(rows.select(key.cast(nullable).alias("doc_id"), text.alias("text")), shingle_words, max_bits)
        gone = materialise(named.where("doc_id.number <> component_id.number").select("doc_id.number"), "gone")
        keep.append(gone)
    # few rows to drop leave the texts where they are
    hinted = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("shuffle_hash")
    return rows.join(hinted, "number", "left_anti").select(*restored(docs.columns))
