"""Ranked lexical search over a length-stratified index.

Documents are grouped by equal normaliser m (a rounded relative length); a
stratum is cut into blocks of a bounded number of postings. One row of the
index is a block: its documents, its terms, and per term the postings in order
of falling term frequency, one group per frequency. Inside a block a term has
one impact per frequency, so impacts are computed once per group, and a
document is scored wholly within its block: nothing but the best documents of
each task is ever shuffled.

Queries run in blocks of ``ITEMS``. Per query and stratum the largest
frequencies bound what a document can score. A first visit scores one block of
each query's ``FIRST_STRATA`` strata of highest bound, which gives the score
that a document must reach. A second visit reads the strata whose bound
reaches it for some query, and in them scores a query only in the blocks whose
own bound reaches the better of that score and the best found so far in the
task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kerbside.llm.common import small_batches
from kerbside.operators.joins import BROADCAST_ROWS, skew_join
from kerbside.operators.ordinals import with_ordinal
from kerbside.session import materialise, working_tables

TOP = 10
BLOCK_POSTINGS = 400_000
TASK_POSTINGS = 2_000_000  # about as many are put into blocks by one task
ITEMS = 1024
FIRST_STRATA = 4
_PART = 500_000  # postings and scores worked on at once

# A-Z become small, other ASCII characters that are no letter or digit become spaces.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)
_LONG = "array<int>"
_BLOCK = (
    "m int, block int, doc_ids array<{}>, terms array<string>, n_docs {l}, max_tf {l}, groups {l}, tfs {l}, "
    "counts {l}, docs {l}"
)


class Index(NamedTuple):
    blocks: DataFrame
    n_docs: int


def term_counts(docs: DataFrame, key: str) -> DataFrame:
    """(number, id, words, terms, tfs) of every row whose text has a term; ``number`` tells rows apart."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col(key).alias("id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, words, sizes, terms, tfs = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = Counter((text or "").encode("utf-8", "replace").translate(_FOLD).split())
                if found:
                    places.append(i)
                    words.append(found.total())
                    sizes.append(len(found))
                    terms.extend(found)
                    tfs.extend(found.values())
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))],
                ["number", "id", "words", "terms", "tfs"])

    return small_batches(rows).mapInArrow(
        count, f"number bigint, id {kind}, words bigint, terms array<string>, tfs array<int>")


def _block(m: int, number: int, rows: pa.Table) -> pa.RecordBatch:
    """One row of the index from the documents of a block."""
    rows = rows.take(pc.sort_indices(rows["id"])).combine_chunks()  # nulls last: places in order of id
    lists = rows["terms"].chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    tfs = rows["tfs"].chunk(0).flatten().to_numpy()
    docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.lexsort((docs, -tfs, codes))
    codes, tfs, docs = codes[order], tfs[order], docs[order]
    new_term = np.append(True, codes[1:] != codes[:-1])
    new_group = new_term | np.append(True, tfs[1:] != tfs[:-1])
    firsts, groups = np.flatnonzero(new_term), np.flatnonzero(new_group)

    def one(values) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(np.asarray(values, np.int32))
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_arrays(
        [pa.array([m], pa.int32()), pa.array([number], pa.int32()), one(rows["id"].chunk(0)), one(coded.dictionary),
         one(np.diff(np.append(firsts, len(codes)))), one(tfs[firsts]),
         one(np.diff(np.append(np.searchsorted(groups, firsts), len(groups)))), one(tfs[groups]),
         one(np.diff(np.append(groups, len(codes)))), one(docs)],
        ["m", "block", "doc_ids", "terms", "n_docs", "max_tf", "groups", "tfs", "counts", "docs"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from rows in order of (m, block)."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        m, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((m[1:] != m[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(m)]):
            if held and key != (m[a], block[a]):
                yield _block(*key, pa.Table.from_batches(held))
                held = []
            key = (m[a], block[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield _block(*key, pa.Table.from_batches(held))


def build_index(docs: DataFrame, key: str = "doc_id", block_postings: int = BLOCK_POSTINGS) -> Index:
    """Index of all rows of ``docs``, written; rows without a term are left out, null texts among them."""
    kind = docs.schema[key].dataType.simpleString()
    with working_tables() as keep:
        counted = materialise(term_counts(docs, key), "terms")
        total = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).first()
        n_docs, n_words = total["n"], total["words"] or 1
        placed = counted.withColumn("m", (F.expr(f"75 * words * {n_docs}L div {n_words}L") + 25).cast("int"))
        strata = materialise(
            placed.groupBy("m").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("terms")).alias("postings")), "strata")
        blocks = strata.select("m", F.ceil(F.col("postings") / block_postings).cast("int").alias("blocks"))
        # one stratum may hold most documents, and equal documents may be many: blocks are drawn by row number
        dealt = skew_join(placed, blocks, ["m"], counts=strata.select("m", "rows")).withColumn(
            "block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
        postings = strata.agg(F.sum("postings")).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-postings // TASK_POSTINGS))
        ordered = dealt.select("m", "block", "id", "terms", "tfs").repartition(parts, "m", "block").sortWithinPartitions("m", "block")
        table = materialise(
            small_batches(ordered).mapInArrow(_assemble, _BLOCK.format(kind, l=_LONG)), "index")
        keep.append(table)
    return Index(table, n_docs)


class Queries(NamedTuple):
    """One block of queries as arrays: terms, and per (item, term) the item, the term and its weight times repeats."""

    terms: list[str]
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    least: np.ndarray  # score that a document must reach, per item
    visits: dict[int, list[int]] | None  # items to score per m; all in every block if None


def _kind(index: Index) -> str:
    return index.blocks.schema["doc_ids"].dataType.elementType.simpleString()


def _impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _sums(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by place."""
    if not len(values) or float(values.max()) * len(values) < 2.0 ** 53:
        return np.bincount(places, values, n).astype(np.int64)
    low = np.bincount(places, values & 0x3FFFFFF, n).astype(np.int64)
    return (np.bincount(places, values >> 26, n).astype(np.int64) << 26) + low


def _best(shared, top: int, kind: pa.DataType) -> Callable:
    """Rows (item, id, score): the best documents per item among the blocks of a task, ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(*shared.value)
        terms = pa.array(q.terms, pa.string())
        n_items = len(q.least)
        least = q.least.copy()
        best: dict[int, list] = {}

        def keep(i: int, scores: np.ndarray, hits: np.ndarray, doc_ids: pa.Array) -> None:
            hits = hits[np.lexsort((hits, -scores[hits]))[:top]]  # places are in order of id
            ids = doc_ids.take(pa.array(hits)).to_pylist()
            held = best.setdefault(i, [])
            held += [(-int(s), d is None, 0 if d is None else d) for s, d in zip(scores[hits], ids)]
            held.sort()
            del held[top:]
            if len(held) == top:
                least[i] = max(least[i], -held[-1][0])

        for batch in batches:
            for r in range(batch.num_rows):
                def values(name: str) -> pa.Array:
                    return batch.column(name)[r].values
                m = batch.column("m")[r].as_py()
                here = pc.index_in(values("terms"), terms).to_numpy(zero_copy_only=False)
                known = np.flatnonzero(~np.isnan(here.astype(float)))
                place = np.full(len(terms), -1)
                place[here[known].astype(int)] = known
                at = place[q.term]  # place of each pair's term in the block
                found = at >= 0
                impact = _impact(values("max_tf").to_numpy().astype(np.int64), m)
                bound = _sums(q.item[found], q.weight[found] * impact[at[found]], n_items)
                items = np.flatnonzero((bound >= least) & (bound > 0))
                if q.visits is not None:
                    items = np.intersect1d(items, q.visits.get(m, []))
                if not len(items):
                    continue
                doc_ids, docs = values("doc_ids"), values("docs").to_numpy()
                of_group = _impact(values("tfs").to_numpy().astype(np.int64), m)  # once per term and tf
                of_posting = np.repeat(of_group, values("counts").to_numpy())
                n_docs = values("n_docs").to_numpy()
                begins = np.cumsum(n_docs) - n_docs
                pairs = np.flatnonzero(found & np.isin(q.item, items))
                sizes = n_docs[at[pairs]].astype(np.int64)
                # as many items at once as their postings and scores fit into a part
                load = np.cumsum(np.bincount(q.item[pairs], sizes, n_items)[items] + len(doc_ids)) // _PART
                for part in np.split(items, np.flatnonzero(np.diff(load)) + 1):
                    mine = (q.item[pairs] >= part[0]) & (q.item[pairs] <= part[-1])
                    p, n = pairs[mine], sizes[mine]
                    where = np.arange(n.sum()) + np.repeat(begins[at[p]] - (np.cumsum(n) - n), n)
                    row = np.repeat(np.searchsorted(part, q.item[p]), n)
                    scores = _sums(
                        row * len(doc_ids) + docs[where], np.repeat(q.weight[p], n) * of_posting[where],
                        len(part) * len(doc_ids)).reshape(len(part), -1)
                    hit = (scores >= least[part][:, None]) & (scores > 0)
                    for k in np.flatnonzero(hit.any(axis=1)):
                        keep(int(part[k]), scores[k], np.flatnonzero(hit[k]), doc_ids)
        for i, held in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(held), pa.int32()), pa.array([None if none else d for _, none, d in held], kind),
                 pa.array([-s for s, _, _ in held], pa.int64())],
                ["item", "id", "score"])
    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(index: Index, items: DataFrame, first: int, top: int) -> DataFrame:
    """(item, rank, id, score) for the counted items numbered from ``first``, at most ``ITEMS`` of them."""
    spark = index.blocks.sparkSession
    kind = _kind(index)
    rows = items.where(F.col("ordinal").between(first, first + ITEMS - 1)).select("ordinal", "terms", "tfs").collect()
    pairs = sorted((r["ordinal"] - first, t, n) for r in rows for t, n in zip(r["terms"], r["tfs"]))
    wanted = spark.createDataFrame(sorted({(t,) for _, t, _ in pairs}), "term string")
    # largest frequency and number of documents per stratum, for the terms of these queries only
    seen = materialise(
        index.blocks.select("m", F.explode(F.arrays_zip("terms", "n_docs", "max_tf")).alias("t"))
        .select("m", F.col("t.terms").alias("term"), F.col("t.n_docs").alias("n"), F.col("t.max_tf").alias("tf"))
        .join(F.broadcast(wanted), "term", "left_semi")
        .groupBy("m", "term").agg(F.sum("n").alias("n"), F.max("tf").cast("long").alias("tf")), "seen")
    df = F.sum("n")
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.n_docs) + 2) / (2 * df + 1))).cast("long")
    weights = dict(seen.groupBy("term").agg(weight.alias("w")).collect())
    pairs = [(i, t, n * weights[t]) for i, t, n in pairs if t in weights]
    terms = sorted({t for _, t, _ in pairs})
    number = {t: i for i, t in enumerate(terms)}
    base = Queries(
        terms, np.array([i for i, _, _ in pairs], int), np.array([number[t] for _, t, _ in pairs], int),
        np.array([w for _, _, w in pairs], np.int64), np.ones(ITEMS, np.int64), None)
    weighted = F.broadcast(spark.createDataFrame(pairs, "item int, term string, weight bigint"))
    bounds = materialise(
        seen.join(weighted, "term").groupBy("item", "m")
        .agg(F.sum(F.expr("weight * ((1000000000 * tf) div (1000 * tf + 8 * m))")).alias("bound")), "bounds")

    def visit(blocks: DataFrame, queries: Queries) -> DataFrame:
        shared = spark.sparkContext.broadcast(tuple(queries))
        ids = to_arrow_type(index.blocks.schema["doc_ids"].dataType.elementType)
        return _ranked(blocks.mapInArrow(_best(shared, top, ids), f"item int, id {kind}, score bigint"), top)

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    visits: dict[int, list[int]] = {}
    for item, m in bounds.withColumn("at", F.row_number().over(order)).where(
            F.col("at") <= FIRST_STRATA).select("item", "m").collect():
        visits.setdefault(m, []).append(item)
    start = index.blocks.where((F.col("block") == 0) & F.col("m").isin(list(visits)))
    least = dict(visit(start, base._replace(visits=visits)).where(F.col("rank") == top).select("item", "score").collect())
    queries = base._replace(least=np.array([least.get(i, 1) for i in range(ITEMS)], np.int64))
    reach = spark.createDataFrame([(i, least.get(i, 1)) for i in range(ITEMS)], "item int, least bigint")
    alive = materialise(bounds.join(F.broadcast(reach), "item").where("bound >= least").select("m").distinct(), "alive")
    if alive.count() <= BROADCAST_ROWS:  # blocks then stay where they are
        alive = F.broadcast(alive)
    found = visit(index.blocks.join(alive, "m", "left_semi"), queries)
    return materialise(found.select((F.col("item") + first).alias("ordinal"), "rank", "id", "score"), "found")


def search(index: Index, items: DataFrame, key: str = "item_id", top: int = TOP) -> DataFrame:
    """(key, rank, doc_id, score): the ``top`` best documents per row of ``items``, written.

    Items without a term, or whose terms no document holds, give no rows; rows
    with equal or null keys are items of their own. Equal scores are ranked by
    ascending doc_id, null ones last.
    """
    spark = items.sparkSession
    with working_tables() as keep:
        counted = materialise(with_ordinal(term_counts(items, key), ["number"]), "items")
        result = spark.createDataFrame([], f"ordinal bigint, rank int, id {_kind(index)}, score bigint")
        for first in range(0, counted.count() if index.n_docs else 0, ITEMS):
            result = result.unionByName(_search_block(index, counted, first, top))
        named = counted.select("ordinal", F.col("id").alias(key))
        result = materialise(
            result.withColumnRenamed("id", "doc_id").join(named, "ordinal").select(key, "rank", "doc_id", "score"), "ranked")
        keep.append(result)
    return result


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The best documents per item: index all documents, search, delete the index.

    Documents: doc_id, text; items: item_id, text. Null and empty texts have no
    terms. Rows with equal or null doc_id are documents of their own. An empty
    table on either side gives no rows. Other columns are not read.
    """
    with working_tables() as keep:
        result = search(build_index(docs), items, top=top)
        keep.append(result)
    return result
