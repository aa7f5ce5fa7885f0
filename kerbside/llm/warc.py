"""WARC files and a Merkle fixity audit of their replicas.

Pages are written as WARC 1.1 records, one file per shard. The audit hashes
every record of a file with its byte range, and what lies between records as
ranges of their own. Byte ranges of one power of two are the lowest nodes of
the tree: hash of the places and hashes they hold, in order. Neighbouring ranges make the
next node, 64 at a time, up to the shard, and neighbouring shards the next, up
to the root. Two replicas are compared from the root; a level is read only
below nodes that differ, so equal parts cost one hash comparison each. Below
the lowest of them, records are matched by id and hash first, so a lost or
added record does not make those behind it look damaged.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.session import materialise, scratch_path, working_tables

SHARD_BYTES = 8 << 20
RANGE_BITS = 16       # bytes of a lowest node
FAN_BITS = 6          # 64 children of a node
SHARD_BITS = 40       # no shard reaches this many bytes
# The record syntax.
_VERSION = "WARC/1.1"
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_HEAD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)
_FIELD = re.compile(rb"^(WARC-Record-ID|Content-Length): *(.*?)\r?$", re.M)


def _records(pages: DataFrame) -> Column:
    """The text of a record without the line ends behind it."""
    one_line = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\x00-\x20]", "_")
    html = F.coalesce(F.col("html"), F.lit(""))
    fields = {
        "WARC-Type": F.lit("resource"),
        "WARC-Record-ID": F.concat(F.lit("<urn:page:"), one_line("page_id"), F.lit(">")),
        "WARC-Date": F.lit(_DATE),
        "WARC-Target-URI": one_line("url"),
        "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.sha2(html, 256)),
        "Content-Type": F.lit("text/html"),
        "Content-Length": F.octet_length(html).cast("string"),
    }
    lines = [F.lit(_VERSION), *[F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), html)


def write_warc(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files ``path/shard=k``, in the order of page_id.

    A null html is an empty payload, a null id or url an empty field; repeated
    pages are repeated records. Other columns are ignored. An empty table
    writes no file. Shards are dealt by the
    MD5 of the id; a page is never split.
    """
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = 1 + size // shard_bytes
    parts = int(min(shards, 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = pages.select(
        (F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
         % F.lit(shards)).alias("shard"), "page_id", _records(pages).alias("value"))
    (
        rows.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard", "page_id", "value")
        .select("shard", "value").write.partitionBy("shard")
        .option("lineSep", _END).option("compression", "gzip").text(path)
    )


def _parse(data: bytes) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, record id) of the records of a file, end marks included; id None for other bytes."""
    at = 0
    while at < len(data):
        head = _HEAD.match(data, at)
        fields = dict(_FIELD.findall(head[1])) if head else {}
        size = fields.get(b"Content-Length", b"")
        end = head.end() + int(size) + 4 if head and size.isdigit() else -1
        if 0 <= end <= len(data) and data[end - 4:end] == b"\r\n\r\n":
            yield at, end, fields.get(b"WARC-Record-ID", b"").decode("utf-8", "replace")
        else:  # go on at the next record that can be made out
            end = data.find(b"WARC/1.1\r\n", at + 1)
            end = len(data) if end < 0 else end
            yield at, end, None
        at = end


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:  # a folder without shards
        files = files.withColumn("shard", F.lit(0))
    return files.select(F.col("shard").cast("long").alias("shard"), "content")


def _plain(content: bytes) -> bytes:
    return zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content


def read_leaves(spark: SparkSession, path: str) -> DataFrame:
    """(shard, offset, length, record_id, hash) of all records and other byte ranges below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = _plain(content.as_py())
                found = list(_parse(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(found), pa.int64()), pa.array([a for a, _, _ in found], pa.int64()),
                     pa.array([b - a for a, b, _ in found], pa.int64()), pa.array([r for _, _, r in found], pa.string()),
                     pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b, _ in found], pa.string())],
                    ["shard", "offset", "length", "record_id", "hash"])

    return _files(spark, path).mapInArrow(
        run, "shard bigint, offset bigint, length bigint, record_id string, hash string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(shard, offset, record_id, payload) of all readable records below ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = _plain(content.as_py())
                found = [(a, r, data[_HEAD.match(data, a).end():b - 4]) for a, b, r in _parse(data) if r is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(found), pa.int64()), pa.array([a for a, _, _ in found], pa.int64()),
                     pa.array([r for _, r, _ in found], pa.string()), pa.array([p for _, _, p in found], pa.binary())],
                    ["shard", "offset", "record_id", "payload"])

    return _files(spark, path).mapInArrow(run, "shard bigint, offset bigint, record_id string, payload binary")


def copy_replica(spark: SparkSession, path: str, target: str, change: Callable[[str, bytes], bytes] | None = None) -> None:
    """Copy the files below ``path``; ``change`` may give other bytes of equal length for a record (id, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = _plain(content.as_py())
                if change is not None:
                    data = b"".join(change(r, data[a:b]) if r is not None else data[a:b] for a, b, r in _parse(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([data[:-4]], pa.binary())], ["shard", "value"])

    (
        _files(spark, path).mapInArrow(run, "shard bigint, value binary")
        .select("shard", F.col("value").cast("string").alias("value"))
        .write.partitionBy("shard").option("lineSep", _END).option("compression", "gzip").text(target)
    )


def _levels(shards: int) -> list[Column]:
    """Node number of a (shard, offset) on each level, lowest first; the last level has one node."""
    place = F.shiftleft(F.col("shard"), SHARD_BITS).bitwiseOR(F.col("offset"))
    bits, top = RANGE_BITS, SHARD_BITS + max(1, shards).bit_length()
    numbers = []
    while bits < top + FAN_BITS:
        numbers.append(F.shiftright(place, bits))
        bits += FAN_BITS
    return numbers


def merkle_tree(leaves: DataFrame, shards: int) -> list[DataFrame]:
    """Tables (node, parent, hash) from the lowest level to the root; each written."""
    numbers = _levels(shards)
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: F.concat_ws(":", x["at"], x["hash"])), ","), 256)
    rows = leaves.select(numbers[0].alias("node"), F.col("offset").alias("at"), "hash")
    levels = []
    for _ in numbers:
        nodes = rows.groupBy("node").agg(joined.alias("hash"))
        nodes = materialise(nodes.withColumn("parent", F.shiftright("node", FAN_BITS)), "nodes")
        levels.append(nodes)
        rows = nodes.select(F.col("parent").alias("node"), F.col("node").alias("at"), "hash")
    return levels


def _ranked(leaves: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number equal ``keys`` of a shard in the order of their places."""
    order = Window.partitionBy("shard", *keys).orderBy("offset")
    return leaves.withColumn(name, F.row_number().over(order))


def _met(ranges: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """Add whether a range (shard, start, end) shares a byte with one of ``others`` of its shard.

    One sorted pass per shard: a range meets another if, of those that begin
    before its last byte, the one that ends last ends behind its first.
    """
    points = ranges.withColumn("_at", F.col("end") - 1).withColumn("_own", F.lit(True)).unionByName(
        others.select("shard", F.col("start").alias("_at"), F.col("end").alias("_reach"), F.lit(False).alias("_own")),
        allowMissingColumns=True)
    order = Window.partitionBy("shard").orderBy("_at", "_own").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(name, F.coalesce(F.max("_reach").over(order) > F.col("start"), F.lit(False))).where(
        "_own").drop("_at", "_own", "_reach")


def _judged(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(shard, offset, length, record_id, status) from the leaves (with ``run``) below nodes that differ.

    Runs of neighbouring nodes begin behind equal bytes, so within a run the
    last record found again tells how far the replica's places have shifted.
    """
    moved = _ranked(
        ours.join(theirs, ["shard", "offset", "hash"], "left_anti"), ["record_id", "hash"], "copy"
    ).join(
        _ranked(theirs.join(ours, ["shard", "offset", "hash"], "left_anti"), ["record_id", "hash"], "copy")
        .where("record_id IS NOT NULL").select("shard", "record_id", "hash", "copy", F.col("offset").alias("there")),
        ["shard", "record_id", "hash", "copy"],
    ).select("shard", "offset", "length", "record_id", "there")
    moved = materialise(moved, "moved")
    lost = ours.join(theirs, ["shard", "offset", "hash"], "left_anti").join(moved, ["shard", "offset"], "left_anti")
    lost = _ranked(lost.withColumns({"start": F.col("offset"), "end": F.col("offset") + F.col("length")}), ["record_id"], "copy")

    equal = ours.select("shard", "offset", "hash", F.lit(0).cast("long").alias("same"))
    shifts = moved.select("shard", F.col("there").alias("offset"), (F.col("offset") - F.col("there")).alias("shift"))
    behind = Window.partitionBy("shard", "run").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce("same", "shift")
    placed = (
        theirs.join(equal, ["shard", "offset", "hash"], "left").join(shifts, ["shard", "offset"], "left")
        .withColumn("start", F.col("offset") + F.coalesce(F.last(known, ignorenulls=True).over(behind), F.lit(0)))
        .where(known.isNull()).withColumn("end", F.col("start") + F.col("length"))
    )
    placed = materialise(_ranked(placed, ["record_id"], "copy"), "placed")
    unread, records = placed.where("record_id IS NULL"), placed.where("record_id IS NOT NULL")

    # a record with its id, else one in its place, has other bytes; else bytes that are no record lie there or nothing does
    by_id = records.select("shard", "record_id", "copy", F.lit(True).alias("named"))
    lost = materialise(_met(lost.join(by_id, ["shard", "record_id", "copy"], "left"), unread, "unread"), "lost")
    other = records.join(lost.select("shard", "record_id", "copy"), ["shard", "record_id", "copy"], "left_anti")
    nameless = lost.where("named IS NULL").select("shard", "start", F.lit(True).alias("put"))
    status = (
        F.when(F.col("named") | F.col("taken"), F.lit("changed")).when(F.col("unread"), F.lit("unreadable")).otherwise(F.lit("missing"))
    )
    result = ["shard", "offset", "length", "record_id"]
    there = other.groupBy("shard", "start").agg(F.lit(True).alias("taken"))
    gone = lost.join(there, ["shard", "start"], "left").withColumn("taken", F.col("taken") & F.col("named").isNull())
    added = other.join(nameless, ["shard", "start"], "left_anti").select(*result).unionByName(
        _met(unread, lost, "put").where("NOT put").select(*result))
    return (
        gone.select(*result, status.alias("status")).unionByName(added.withColumn("status", F.lit("extra")))
        .unionByName(moved.select(*result, F.lit("moved").alias("status")))
    )


def audit(spark: SparkSession, path: str, replica: str) -> DataFrame:
    """(shard, offset, length, record_id, status) of the byte ranges in which ``replica`` departs; written.

    Status: changed (a record with other bytes), unreadable (bytes where one
    was that hold no record; each record of a destroyed stretch), missing
    (nothing there), extra (only in the replica, with its place there), moved
    (whole, but elsewhere in the shard, as behind a record that was lost).
    Equal replicas give no rows; so do two empty ones. Of records alike in id
    and bytes, the first in one file counts as the first in the other.
    """
    with working_tables() as keep:
        ours, theirs = (materialise(read_leaves(spark, p), "leaves") for p in (path, replica))
        shards = max((t.agg(F.max("shard")).first()[0] or 0) for t in (ours, theirs)) + 1
        left, right = merkle_tree(ours, shards), merkle_tree(theirs, shards)
        suspects = None
        for a, b in zip(reversed(left), reversed(right)):
            if suspects is not None:
                a, b = (t.join(suspects.withColumnRenamed("node", "parent"), "parent", "left_semi") for t in (a, b))
            both = a.select("node", F.col("hash").alias("a")).join(b.select("node", F.col("hash").alias("b")), "node", "full")
            suspects = materialise(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "suspects")
            if suspects.isEmpty():
                break
        within = Window.partitionBy(F.shiftright("node", SHARD_BITS - RANGE_BITS)).orderBy("node")
        runs = suspects.withColumn("run", F.col("node") - F.row_number().over(within))
        number = _levels(shards)[0].alias("node")
        here, there = (materialise(t.withColumn("node", number).join(runs, "node").drop("node"), "suspect-leaves") for t in (ours, theirs))
        found = materialise(_judged(here, there), "audit")
        keep.append(found)
    return found


def rot(record_id: str, data: bytes) -> bytes:
    """Damage for trials: by the MD5 of the id in the record, one page in 64 loses a byte's value or all its bytes."""
    page = record_id.removeprefix("<urn:page:").removesuffix(">")
    mark = hashlib.md5(page.encode()).hexdigest()[:2]
    body = _HEAD.match(data).end()
    if body + 4 >= len(data):
        return data
    if mark in ("00", "40"):
        return data[:body] + (b"*" if data[body:body + 1] == b"#" else b"#") + data[body + 1:]
    return bytes(len(data)) if mark in ("80", "c0") else data


def trial(pages: DataFrame) -> DataFrame:
    """Write the pages, damage a copy, audit it: (page_id, shard, offset, length, status) of what is found."""
    spark = pages.sparkSession
    first, second = scratch_path(spark, "warc"), scratch_path(spark, "warc-copy")
    write_warc(pages, first)
    copy_replica(spark, first, second, rot)
    page = F.regexp_extract("record_id", r"<urn:page:(.*)>", 1)
    return audit(spark, first, second).select(page.cast("bigint").alias("page_id"), "shard", "offset", "length", "status")
