"""Substring deduplication by recompression.

Every text is parsed bottom-up into symbols. A round first names maximal runs
of one symbol, then names pairs: symbols fall into two halves of the alphabet
by a bit of their hash, and a symbol of the first half followed by one of the
second becomes one symbol. A name is a hash of what it stands for, so all
tasks give equal substrings equal names without exchanging a dictionary. Only
the symbols at the very ends of a repeat can depend on what lies around it.

Each symbol carries its context: the words that decide that it is formed at
all. A window of words owns the symbols whose context lies inside it, which is
a function of the window's words alone, and is represented by one of them, its
anchor (the lowest by hash). Equal windows thus meet at equal anchors, and
only one anchor in about seven words travels. Windows without an anchor are
their own anchor.

Neighbouring windows with the same anchor travel as one stretch. Stretches of
equal anchors are compared by a hash of all their words; a stretch that equals
an earlier one is removed as a whole. Stretches with equal anchors but
different words are compared window by window. Both comparisons rest on two
independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kerbside.llm.common import numbered, small_batches
from kerbside.operators.ordinals import with_ordinal
from kerbside.session import materialise, working_tables

WINDOW = 20
ROUNDS = 2
CONTEXT = 9            # words that an anchor's name covers at least
_CACHED_WORDS = 500_000
_FLUSH_ROWS = 1_000_000
_BUSY_ROWS = 256       # different stretches of an anchor in one flush of a task beyond which it counts as busy
_PLACE_BITS = 28       # of a rank: symbols of a batch, below the hash
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STATES = ("repeated", "open", "busy", "mark")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Names(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


class _Stretches:
    """Hashes of word ranges of a batch from running sums."""

    def __init__(self, words: np.ndarray):
        self.inverse = _powers(_BASE_INVERSE, len(words))
        terms = _mix(words) * _powers(_BASE, len(words))[: len(words)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(terms)]) if len(words) else np.zeros(1, np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mix(value ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def _parse(words: np.ndarray, text: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, context start, context end) of the symbols of a batch of texts.

    ``text`` numbers the text of each word. A context that reaches over the
    end of a text lies in no window, so the symbol anchors nothing.
    """
    name, low, high, at = words, np.arange(len(words)), np.arange(len(words)) + 1, text
    for turn in range(rounds):
        # maximal runs; that a run ends where it does is decided by its neighbours
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (at[1:] != at[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(name)]]) - 1
        length = last - first + 1
        left = np.where(first > 0, low[first - 1], -1)
        right = np.append(high, len(words) + 1)[last + 1] if len(name) else high[:0]
        run = np.where(length > 1, _mix(name[first] ^ _mix(length.astype(np.uint64), 3 * turn + 1), 3 * turn + 2), name[first])
        name, low, high, at = run, np.minimum(left, low[first]), np.maximum(right, high[last]), at[first]
        # pairs of a symbol of the first half and one of the second
        second = (_mix(name, 3 * turn + 3) & np.uint64(1)).astype(bool)
        opens = np.zeros(len(name), bool)
        opens[:-1] = ~second[:-1] & second[1:] & (at[:-1] == at[1:])
        closes = np.concatenate([[False], opens[:-1]])
        # an unpaired symbol depends on the neighbour that it could have joined
        reach_low = np.where(second & ~closes, np.concatenate([[-1], low[:-1]]), low)
        reach_high = np.where(~second & ~opens, np.append(high[1:], len(words) + 1), high)
        pair = np.flatnonzero(opens)
        joined = name.copy()
        joined[pair] = _mix(name[pair] ^ _mix(name[pair + 1], 3 * turn + 2), 3 * turn + 1)
        low = np.minimum(low, reach_low)
        high = np.maximum(high, reach_high)
        low[pair] = np.minimum(low[pair], low[pair + 1])
        high[pair] = np.maximum(high[pair], high[pair + 1])
        kept = ~closes
        name, low, high, at = joined[kept], low[kept], high[kept], at[kept]
    return name, low, high


def _anchors(words: np.ndarray, text: np.ndarray, window: int, rounds: int, context: int):
    """(anchor, stretch, start, windows) of all stretches of a batch, places in the batch."""
    n = len(words)
    stretches = _Stretches(words)
    firsts = np.arange(max(0, n - window + 1))
    valid = text[firsts] == text[firsts + window - 1]
    name, low, high = _parse(words, text, rounds)
    size = np.maximum(high - low, min(context, window))
    low = low - (size - (high - low)) // 2
    high = low + size
    inside = (size <= window) & (low >= 0) & (high <= n)
    low, high, name = low[inside], high[inside], name[inside]
    rank = _mix(name, 101) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(len(name), dtype=np.uint64)
    best = np.full(len(firsts), _NONE)
    for back in range(window):
        # windows that start ``back`` words before the context
        start = low - back
        fits = (start >= 0) & (start + window >= high) & (start < len(firsts))
        np.minimum.at(best, start[fits], rank[fits])
    start = firsts[valid]
    best = best[valid]
    if not len(start):
        return None
    found = best != _NONE
    place = (best & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    place = np.where(found, place, -1 - start)  # a window without anchor stands alone
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    first, place = start[head], place[head]
    alone = place < 0
    inner_low = np.where(alone, first, low[np.where(alone, 0, place)] if len(low) else first)
    inner_high = np.where(alone, first + window, high[np.where(alone, 0, place)] if len(low) else first + window)
    anchor = _mix(stretches.of(inner_low, inner_high), 17)
    return anchor, stretches.of(first, first + count - 1 + window), first, count


class _Batch:
    """Words of a batch of texts as one array, with the text and the place in it of each."""

    def __init__(self, texts: list[bytes | None], names: _Names):
        split = [t.split() if t else [] for t in texts]
        self.split = split
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.fromiter((names[w] for s in split for w in s), np.uint64, int(self.begin[-1]))
        self.text = np.repeat(np.arange(len(texts)), self.sizes)


def _placed(docs: DataFrame, keep: list[DataFrame]) -> DataFrame:
    """``doc`` and the numbered columns; ``doc`` tells rows apart and follows the order of doc_id, null first.

    Whole-number ids without repeats are taken as they are. Otherwise rows are
    sorted by id, those of one id by a hash of the text, and numbered.
    """
    doc_id, text = (f"_kept_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = docs.select(*numbered(docs.columns))
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    if whole and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), "*")
    table = materialise(with_ordinal(rows, [doc_id, F.xxhash64(text)], "doc"), "placed")
    keep.append(table)
    return table


def _stretches(texts: DataFrame, window: int, rounds: int, context: int) -> DataFrame:
    """(anchor, stretch, doc, start, windows, state): what a task settles and what is left to compare.

    A stretch that equals an earlier one of the same task is ``repeated`` and
    takes no part in the comparison, so a passage of any frequency sends one
    row per task to its anchor. An anchor with very many different stretches
    in a task is busy: they go to the comparison of windows at once (state
    ``busy``), and a single ``mark`` tells the other tasks' stretches of that
    anchor to do the same. The rest is ``open``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            anchor, stretch, doc, start, count = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((start, doc, stretch, anchor))
            anchor, stretch, doc, start, count = (x[order] for x in (anchor, stretch, doc, start, count))
            same = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (stretch[1:] == stretch[:-1])])
            # an equal place is the same document again, not an earlier one
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            later = same & ((doc != doc[head]) | (start != start[head]))
            _, group, rows_of = np.unique(anchor[~later], return_inverse=True, return_counts=True)
            state = np.where(later, 0, 1)
            state[~later] = np.where(rows_of[group] > _BUSY_ROWS, 2, 1)
            busy = np.unique(anchor[state == 2])
            none = np.zeros(len(busy), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([anchor, busy]).view(np.int64)),
                 pa.array(np.concatenate([stretch, _mix(busy, 23)]).view(np.int64)), pa.array(np.concatenate([doc, none])),
                 pa.array(np.concatenate([start, none]).astype(np.int32)),
                 pa.array(np.concatenate([count, none]).astype(np.int32)),
                 pa.array([_STATES[k] for k in np.concatenate([state, none + 3]).tolist()], pa.string())],
                ["anchor", "stretch", "doc", "start", "windows", "state"])

        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            part = _Batch(batch.column(1).to_pylist(), names)
            if len(part.words) < window:
                continue
            found = _anchors(part.words, part.text, window, rounds, context)
            if found is None:
                continue
            anchor, stretch, first, count = found
            text = part.text[first]
            held.append((anchor, stretch, doc[text], first - part.begin[text], count))
            rows += len(anchor)
            if rows >= _FLUSH_ROWS:
                rows = 0
                yield from flush()
        yield from flush()

    return small_batches(texts).mapInArrow(
        run, "anchor bigint, stretch bigint, doc bigint, start int, windows int, state string")


def _windows(texts: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(anchor, hash, doc, start) of the windows of the stretches ``asked``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for batch in batches:
            part = _Batch(batch.column(1).to_pylist(), names)
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(2)
            owner = np.repeat(np.arange(len(doc)), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            start, count, anchor = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            owner, anchor, first = (np.repeat(x, count) for x in (owner, anchor, start))
            step = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
            at = part.begin[owner] + first + step
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(_Stretches(part.words).of(at, at + window).view(np.int64)),
                 pa.array(doc[owner]), pa.array((first + step).astype(np.int32))],
                ["anchor", "hash", "doc", "start"])

    per_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("asked"))
    rows = texts.join(per_doc.hint("shuffle_hash"), "doc").select("doc", "text", "asked")
    return rows.mapInArrow(run, "anchor bigint, hash bigint, doc bigint, start int")


def repeated_ranges(
    texts: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, context: int = CONTEXT
) -> DataFrame:
    """(doc, start, windows): runs of windows whose words also start earlier; written.

    ``texts`` holds ``doc``, a long of its own per row, and ``text`` as bytes.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _stretches(texts, window, rounds, context)
    # what needs no comparison here spreads evenly instead of following its anchor
    compared = F.col("state").isin("open", "mark")
    key = F.when(compared, F.col("anchor")).otherwise(F.xxhash64("doc", "start"))
    rows = rows.withColumns({"key": key, "compared": compared}).repartition(parts, "key")
    same = Window.partitionBy("key", "compared", "stretch").orderBy("doc", "start")
    group = Window.partitionBy("key", "compared")
    judged = materialise(
        rows.withColumns({
            "first": F.first(F.struct("doc", "start")).over(same),
            "copy": F.row_number().over(same),
            "several": F.min("stretch").over(group) != F.max("stretch").over(group),
        })
        .withColumn("covered", (F.col("state") == "repeated") | (
            (F.col("state") == "open") & (F.col("first") != F.struct("doc", "start"))))
        .where("covered OR state = 'busy' OR (state = 'open' AND several AND copy = 1)")
        .select("anchor", "doc", "start", "windows", "covered"),
        "judged",
    )
    covered = judged.where("covered").select("doc", "start", "windows")
    asked = judged.where("NOT covered")
    hashed = materialise(_windows(texts, asked, window), "windows")
    firsts = (
        hashed.groupBy("anchor", "hash")
        .agg(F.min(F.struct("doc", "start")).alias("first"), F.max(F.struct("doc", "start")).alias("last"))
        .where(F.col("first") != F.col("last")).select("anchor", "hash", "first")
    )
    later = (
        hashed.join(firsts, ["anchor", "hash"]).where(F.struct("doc", "start") != F.col("first"))
        .select("doc", "start", F.lit(1).alias("windows")).distinct()
    )
    return materialise(covered.unionByName(later), "covered")


def _kept(docs: DataFrame, window: int, keep: list[str], schema: str, finish) -> DataFrame:
    """``finish(column values of keep, texts, kept words, number of words)`` per batch of documents."""
    with working_tables() as kept:
        placed = _placed(docs, kept)
        text = F.col(f"_kept_{docs.columns.index('text')}").cast("binary")
        ranges = repeated_ranges(placed.select("doc", text.alias("text")), window)
        kept.append(ranges)
    per_doc = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("covered"))
    rows = placed.select("doc", text.alias("_text"), *[f"_kept_{docs.columns.index(c)}" for c in keep])
    rows = rows.join(per_doc.hint("shuffle_hash"), "doc", "left").drop("doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            covered = batch.column(batch.num_columns - 1)
            left, sizes = [], []
            for i, text in enumerate(texts):
                words = text.split() if text else []
                sizes.append(len(words))
                found = covered[i]
                if found.is_valid and words:
                    runs = found.values
                    start = runs.field(0).to_numpy(zero_copy_only=False)
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.minimum(start, len(words)), 1)
                    np.add.at(change, np.minimum(start + runs.field(1).to_numpy(zero_copy_only=False) - 1 + window, len(words)), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    words = [w for w, out in zip(words, gone.tolist()) if not out]
                left.append(words)
            yield finish([batch.column(1 + i) for i in range(len(keep))], texts, left, sizes)

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.

    Words are separated by ASCII white space. A word goes if a window of
    ``window`` words around it has its words also at an earlier place: a
    smaller doc_id, or the same document and an earlier start. Rows with equal
    doc_id are documents of their own, one before the other, so of repeated rows
    one keeps its words. Null ids come before all others. Null texts have no
    words. Texts shorter than a window and empty tables lose nothing.
    """
    def finish(kept, texts, left, sizes):
        return pa.RecordBatch.from_arrays(
            [kept[0], pa.array(sizes, pa.int64()), pa.array([n - len(w) for n, w in zip(sizes, left)], pa.int64()),
             pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in left], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _kept(
        docs, window, ["doc_id"], f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string", finish)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated words removed, columns unchanged; texts that lose nothing stay as they are."""
    names = docs.columns

    def finish(kept, texts, left, sizes):
        place = names.index("text")
        whole = kept[place].to_pylist()
        text = [t if len(w) == n else b" ".join(w).decode("utf-8", "replace") for t, w, n in zip(whole, left, sizes)]
        return pa.RecordBatch.from_arrays(
            [pa.array(text, pa.string()) if i == place else c for i, c in enumerate(kept)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return _kept(docs, window, names, schema, finish)
