"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the word windows of the benchmark items, in classes of equal
length. A shift table over blocks of two words says how far the search may
jump: no pattern holds the block any nearer to its end. Where the shift is
zero the block ends some pattern; the bucket of that suffix lists the patterns
to test, and only a direct comparison of all words counts as an occurrence.

The documents are read once and never shuffled. The benchmark is a query set:
its patterns are sent to the tasks in blocks of at most ``BLOCK_WORDS`` words,
and a task holds one block and one batch of documents at a time, so a
benchmark of any size is searched in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import numbered, numbered_schema, restored, small_batches
from kerbside.session import materialise, working_tables

WINDOW = 10
BLOCK_WORDS = 200_000
_PIECE_WORDS = 10_000
# A-Z to a-z; every other ASCII byte that is neither digit nor letter separates words
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Patterns:
    """Shift tables and suffix buckets for one block of windows."""

    def __init__(self, windows: Iterable[tuple[tuple[bytes, ...], str]]):
        self.ids: dict[bytes, int] = {}
        items: dict[tuple[int, ...], set[str]] = {}
        for words, item in windows:
            key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words)
            items.setdefault(key, set()).add(item)
        self.base = len(self.ids) + 1
        self.classes = []
        for length in sorted({len(k) for k in items}):
            block = min(2, length)
            shifts: dict[int, int] = {}
            buckets: dict[int, list[tuple[tuple[int, ...], set[str]]]] = {}
            for key, names in items.items():
                if len(key) != length:
                    continue
                for end in range(block, length + 1):
                    code = self._code(key, end, block)
                    shifts[code] = min(shifts.get(code, length), length - end)
                buckets.setdefault(self._code(key, length, block), []).append((key, names))
            self.classes.append((length, block, length - block + 1, shifts, buckets))

    def _code(self, ids, end: int, block: int) -> int:
        return ids[end - 1] if block == 1 else ids[end - 2] * self.base + ids[end - 1]

    def search(self, words: list[bytes], hit: bytearray | None, found: set[str]) -> bytearray | None:
        """Mark the words of occurrences in ``hit`` (made when needed) and add their items to ``found``."""
        get = self.ids.get
        ids = [get(w, 0) for w in words]
        n, base = len(ids), self.base
        for length, block, jump, shifts, buckets in self.classes:
            at = length
            shift_of = shifts.get
            while at <= n:
                code = ids[at - 1] if block == 1 else ids[at - 2] * base + ids[at - 1]
                shift = shift_of(code, jump)
                if shift:
                    at += shift
                    continue
                here = tuple(ids[at - length:at])
                for key, names in buckets[code]:
                    if key == here:
                        hit = hit if hit is not None else bytearray(n)
                        hit[at - length:at] = b"\x01" * length
                        found |= names
                at += 1
        return hit


def _windows(words: list[bytes], item: str, size: int) -> Iterator[tuple[tuple[bytes, ...], str]]:
    if words:
        size = min(size, len(words))
        for i in range(len(words) - size + 1):
            yield tuple(words[i:i + size]), item


def _pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, words, n): items cut into overlapping pieces that hold the same windows; written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, pieces = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for a in range(0, max(len(words) - size + 1, min(len(words), 1)), _PIECE_WORDS):
                    items.append(item)
                    pieces.append(words[a:a + _PIECE_WORDS + size - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array([b" ".join(p) for p in pieces], pa.binary()),
                 pa.array([len(p) for p in pieces], pa.int64())],
                ["item", "words", "n"])

    texts = small_batches(benchmark).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text").cast("binary").alias("text"))
    return materialise(texts.mapInArrow(run, "item string, words binary, n bigint").distinct(), "pieces")


def _blocks(pieces: DataFrame, block_words: int) -> Iterator[list[tuple[bytes, str]]]:
    """The pieces in runs of at most ``block_words`` words (or one piece), one run on the driver at a time."""
    total = pieces.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-2 * total // block_words))
    bucket = F.pmod(F.xxhash64("item", "words"), F.lit(buckets))
    for b in range(buckets):
        rows = pieces.where(bucket == b)
        running = F.sum("n").over(Window.orderBy("item", "words").rowsBetween(Window.unboundedPreceding, 0))
        # hashing evens the buckets out; one that is still too full is cut again
        parts = rows.withColumn("part", F.floor((running - 1) / block_words))
        for part in range(1 + (parts.agg(F.max("part")).first()[0] or 0)):
            found = [(bytes(r["words"]), r["item"]) for r in parts.where(F.col("part") == part).collect()]
            if found:
                yield found


def scan(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The columns ``keep`` of every document, numbered, with ``n_words``, ``n_hit`` and ``items`` (sorted ids found).

    A window is ``window`` consecutive words of an item, or the whole item if
    it has fewer words. Null and wordless texts have no words, null item ids
    count as the empty string, repeated items once. With an empty benchmark
    nothing is hit. Rows are independent, so repeated ones stay.
    """
    context = docs.sparkSession.sparkContext
    with working_tables():
        blocks = [context.broadcast(block) for block in _blocks(_pieces(benchmark, window), block_words)]
    rows = docs.select(*numbered(keep), *([] if "text" in keep else ["text"]))
    place = keep.index("text") if "text" in keep else len(keep)
    names = [*rows.columns[:len(keep)], "n_words", "n_hit", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Patterns] | None = None
        for batch in batches:
            tokens = [words_of(t) for t in batch.column(place).cast(pa.binary()).to_pylist()]
            hits: list[bytearray | None] = [None] * len(tokens)
            found: list[set[str]] = [set() for _ in tokens]
            for k, block in enumerate(blocks):
                if held is None or held[0] != k:
                    held = None
                    held = k, Patterns(x for text, item in block.value for x in _windows(text.split(b" "), item, window))
                for i, words in enumerate(tokens):
                    if words:
                        hits[i] = held[1].search(words, hits[i], found[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [
                    pa.array([len(w) for w in tokens], pa.int64()),
                    pa.array([h.count(1) if h else 0 for h in hits], pa.int64()),
                    pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                ],
                names)

    return small_batches(rows).mapInArrow(
        run, f"{numbered_schema(docs, keep)}n_words bigint, n_hit bigint, items array<string>")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Rows with equal doc_id are reported each; cases as in ``scan``.
    """
    return scan(docs, benchmark, ["doc_id"], window).select(
        *restored(["doc_id"]), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, columns unchanged."""
    return scan(docs, benchmark, docs.columns, window).where("n_hit = 0").select(*restored(docs.columns))
