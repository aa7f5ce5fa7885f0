"""Token ids in training order as binary shards.

Documents are encoded with a public byte-level vocabulary, an end marker is
put behind each, and the ids are cut into sequences of one length. A keyed
Feistel permutation over the smallest even number of bits that holds the
number of sequences, walked along its cycle until it falls inside, gives every
sequence a global slot: a pseudo-random order that needs no sort, no table and
no state, and that can be computed for any sequence anywhere.

Slots are cut into ranges; each range is one shard file in which sequence i
stands at i times the stride. A reader goes through shards front to back and
resumes from a slot number alone.

Two passes: encoding writes packs of consecutive sequences, compressed; once
the number of sequences of every pack is known, their running sums number all
sequences, and one exchange moves each to the partition of its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.llm.common import small_batches
from kerbside.session import materialise, scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
SEQUENCE = 2048
SHARD_BYTES = 16 << 20
KEY = 0x5EED
# Fixed value: the published splitting pattern of the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PACK_IDS = 1 << 21
_CACHED_WORDS = 250_000
_LEVEL = 6
_SHARD_END = "\n"      # one byte behind the last sequence of a shard, written by the text sink
_ROUNDS = 6


class Encoder:
    """Ids of texts as little-endian 16-bit bytes; words behind a single space are remembered.

    A single space between two other characters always starts a new piece of
    the splitting pattern, so a text may be encoded word by word.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if max(table.values(), default=0) > 0xFFFF:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self._ids = tiktoken.Encoding("shards", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._words: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {}
        self._spaces = re.compile(r"\s\s|^\s|\s$")
        self._single = re.compile(r"(?<=\S) (?=\S)")

    def _bytes(self, text: str) -> bytes:
        return array("H", self._ids(text)).tobytes()

    def _word(self, word: str) -> bytes:
        if len(self._words) >= _CACHED_WORDS:
            self._words.clear()
        stem, tail = word[:-1], word[-1:]
        if tail and tail in ".,;:!?" and stem.isalpha():
            # letters end a piece of the pattern, so punctuation behind them is encoded apart
            known = self._words.get(stem) or self._word(stem)
            if tail not in self._tails:
                self._tails[tail] = self._bytes(tail)
            value = known + self._tails[tail]
        else:
            value = self._bytes(" " + word)
        self._words[word] = value
        return value

    def encode(self, text: str) -> bytes:
        first, *words = (self._single.split(text) if self._spaces.search(text) else text.split(" "))
        known = self._words.get
        return self._bytes(first) + b"".join([known(w) or self._word(w) for w in words])


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of sequence numbers: a keyed permutation of 0 .. n-1."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(_ROUNDS)]
    slots = np.array(index, np.uint64)
    todo = np.arange(len(slots))
    while len(todo):
        left, right = slots[todo] >> half, slots[todo] & mask
        for k in keys:
            x = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((x ^ (x >> np.uint64(29))) & mask)
        slots[todo] = left << half | right
        todo = todo[slots[todo] >= n]
    return slots.astype(np.int64)


def _packs(docs: DataFrame, vocabulary: str, end: int, sequence: int) -> DataFrame:
    """(doc_ids, sizes, sequences, ids, base): packed and compressed ids of consecutive documents; written.

    ``base`` numbers the first sequence of a pack: packs count on within a
    task, and one row per task says where each task starts.
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        marker = array("H", [end]).tobytes()
        doc_ids: list = []
        parts: list[bytes] = []
        held = done = 0

        def pack() -> pa.RecordBatch:
            nonlocal done
            data = b"".join(parts)
            sizes = [len(p) // 2 for p in parts]
            count = -(-len(data) // (2 * sequence))
            done += count
            return pa.RecordBatch.from_arrays(
                [pa.array([doc_ids], pa.list_(doc_type)), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([count], pa.int64()), pa.array([zstandard.compress(data, _LEVEL)], pa.binary()),
                 pa.array([done - count], pa.int64())],
                ["doc_ids", "sizes", "sequences", "ids", "before"])

        for batch in batches:
            encoder = encoder or Encoder(ranks.value)
            doc_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    doc_ids.append(doc_id)
                    parts.append(encoder.encode(text) + marker)
                    held += len(parts[-1])
            if held >= 2 * _PACK_IDS:
                yield pack()
                doc_ids, parts, held = [], [], 0
        if parts:
            yield pack()

    packed = small_batches(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_ids array<{kind}>, sizes array<bigint>, sequences bigint, ids binary, before bigint")
    packed = materialise(packed.withColumn("task", F.spark_partition_id()), "packs")
    tasks = packed.groupBy("task").agg(F.sum("sequences").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = tasks.select("task", F.coalesce(earlier, F.lit(0)).alias("start"))
    return packed.join(F.broadcast(starts), "task").withColumn("base", F.col("start") + F.col("before"))


def _sequences(ids: bytes, sequence: int, end: int) -> np.ndarray:
    """Rows of equal length; the last one of a pack is filled up with the end marker."""
    data = np.frombuffer(zstandard.decompress(ids), "<u2")
    rows = np.full(-(-len(data) // sequence) * sequence, end, "<u2")
    rows[: len(data)] = data
    return rows.reshape(-1, sequence)


def write_shards(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, sequence: int = SEQUENCE,
    shard_bytes: int = SHARD_BYTES, key: int = KEY,
) -> DataFrame:
    """Write the shards below ``path``; returns the index, one row per sequence.

    Index: slot, shard, offset (in the shard's file), doc_ids (documents with
    ids in the sequence), n_ids (without filling), sha256 (of the sequence as
    written). Shard k is the only file of ``path/shard=k``: slots k * s to
    (k + 1) * s - 1 of ``sequence`` little-endian 16-bit ids each, then one
    line feed. Null and empty texts add nothing, rows with equal doc_id are
    documents of their own, an empty table writes no shard and no index row.
    The order is fixed by the key and by how the table is split when read.
    """
    spark = docs.sparkSession
    packs = _packs(docs, vocabulary, end, sequence)
    total = packs.agg(F.sum("sequences")).first()[0] or 0
    stride = 2 * sequence
    per_shard = max(1, shard_bytes // stride)
    shards = -(-total // per_shard)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = _sequences(ids, sequence, end)
                slots = feistel(np.arange(base, base + len(rows)), total, key)
                order = np.argsort(slots)
                shard = slots[order] // per_shard
                for part in np.split(order, np.flatnonzero(np.diff(shard)) + 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(slots[part[0]]) // per_shard], pa.int64()),
                         pa.array([(slots[part] % per_shard).tolist()], pa.list_(pa.int64())),
                         pa.array([zstandard.compress(rows[part].tobytes(), 3)], pa.binary())],
                        ["shard", "places", "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, None

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([rows.tobytes()], pa.binary())], ["shard", "value"])

        for batch in batches:
            for here, places, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if here != shard:
                    if shard is not None:
                        yield whole()
                    shard, rows = here, np.empty((min(per_shard, total - here * per_shard), sequence), "<u2")
                rows[places] = np.frombuffer(zstandard.decompress(ids), "<u2").reshape(-1, sequence)
        if shard is not None:
            yield whole()

    parts = max(1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pieces = packs.select("ids", "base").mapInArrow(scatter, "shard bigint, places array<bigint>, ids binary")
    # consecutive shards go to one partition: a range partitioning without sampling
    ranged = pieces.repartitionById(parts, (F.col("shard") * parts / max(shards, 1)).cast("int"))
    (
        ranged.sortWithinPartitions("shard").mapInArrow(gather, "shard bigint, value binary")
        .select("shard", F.col("value").cast("string").alias("value"))
        .write.partitionBy("shard").option("lineSep", _SHARD_END).text(path)
    )

    kind = packs.schema["doc_ids"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (sizes, base, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                docs_here = batch.column(0)[i].values
                rows = _sequences(ids, sequence, end)
                ends = np.cumsum(sizes)
                starts = np.arange(len(rows)) * sequence
                first = np.searchsorted(ends, starts, side="right")
                last = np.searchsorted(ends, np.minimum(starts + sequence, ends[-1]) - 1, side="right")
                offsets = np.concatenate([[0], np.cumsum(last - first + 1)])
                place = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
                slots = feistel(np.arange(base, base + len(rows)), total, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(slots // per_shard), pa.array(slots % per_shard * stride),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), docs_here.take(pa.array(place))),
                     pa.array(np.minimum(sequence, ends[-1] - starts)),
                     pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows])],
                    ["slot", "shard", "offset", "doc_ids", "n_ids", "sha256"])

    return packs.select("doc_ids", "sizes", "base", "ids").mapInArrow(
        index, f"slot bigint, shard bigint, offset bigint, doc_ids {kind}, n_ids bigint, sha256 string")


def read_shards(spark: SparkSession, path: str, sequence: int = SEQUENCE, shard_bytes: int = SHARD_BYTES,
                first_slot: int = 0) -> DataFrame:
    """(slot, ids) of the shards below ``path`` from ``first_slot`` on; ids is an array of int."""
    stride = 2 * sequence
    per_shard = max(1, shard_bytes // stride)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count = len(data) // stride
                slots = np.arange(count) + shard * per_shard
                rows = np.frombuffer(data, "<u2", count * sequence).reshape(count, sequence)[slots >= first_slot]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots[slots >= first_slot]), pa.array(list(rows.astype(np.int32)), pa.list_(pa.int32()))],
                    ["slot", "ids"])

    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:  # a folder without shards
        files = files.withColumn("shard", F.lit(0))
    files = files.where(F.col("shard") >= first_slot // per_shard).select(F.col("shard").cast("long"), "content")
    return files.mapInArrow(run, "slot bigint, ids array<int>")


def shard_path(spark: SparkSession) -> str:
    """A fresh folder for shards below the shared folder."""
    return scratch_path(spark, "token-shards")
