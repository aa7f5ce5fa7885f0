"""CSV files whose quoted texts hold line breaks, read by many tasks per file.

A file is read as lines, in chunks of bytes. A line break belongs to a text if
an odd number of quotes precedes it in the file, so: count the quotes of each
chunk, add them up over the chunks before it (one row per chunk), and every
chunk knows whether it starts inside a text. It then joins its own lines to
records. What a chunk holds of a record begun before it, or not ended in it, is
put together from the pieces, at most two per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.session import materialise

# Quotes inside quoted text are doubled, as spreadsheets and other readers do.
QUOTING = {"quote": '"', "escape": '"'}
_WHOLE, _TAIL, _HEAD = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order within each (file, start of the chunk)."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _chunks(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether a chunk starts inside a quoted text."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes")).select(
        "file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each chunk: whole ones, the tail left open at its end, the head that ends an earlier one.

    Rows (file, start, kind, text); input (file, start, inside, value).
    """
    key, kind, held = None, _WHOLE, []

    def out(kinds: list[int], texts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(kinds), pa.string()), pa.array([key[1]] * len(kinds), pa.int64()),
             pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], ["file", "start", "kind", "text"])

    def rest() -> Iterator[pa.RecordBatch]:
        if held:  # the chunk ends inside a text
            yield out([_TAIL if kind == _WHOLE else _HEAD], ["\n".join(held)])

    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        cuts = [i for i in range(1, len(files)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(files)]):
            if a == b:
                continue
            if key != (files[a], starts[a]):
                yield from rest() if key else ()
                key, held = (files[a], int(starts[a])), []
                inside = batch.column(2)[a].as_py()
                kind = _HEAD if inside else _WHOLE
            lines = pc.utf8_rtrim(batch.column(3).slice(a, b - a), "\r")
            odd = pc.count_substring(lines, '"').to_numpy() % 2 == 1
            after = np.logical_xor.accumulate(np.append(inside, odd))  # state before each line, and at the end
            inside = bool(after[-1])
            kinds, texts, done = [], [], 0
            lines = lines.to_pylist()
            for end in np.flatnonzero(~after[1:]) + 1:  # lines that end a record
                texts.append("\n".join([*held, *lines[done:end]]))
                kinds.append(kind)
                kind, held, done = _WHOLE, [], end
            held += lines[done:]
            if texts:
                yield out(kinds, texts)
    yield from rest() if key else ()


def _stitched(pieces: DataFrame) -> DataFrame:
    """(file, start, text): each tail with the heads after it, up to the next tail."""
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))  # a chunk's head stands before its tail
    number = F.sum((F.col("kind") == _TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    return (
        pieces.withColumn("number", number).groupBy("file", "number").agg(F.min("start").alias("start"), parts.alias("parts"))
        .select("file", "start", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    )


def read_records(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """The records of CSV files with a header each, written once as Parquet; columns as in ``ddl``, else texts.

    Lines end in a line feed, with or without a carriage return; inside texts
    both become a line feed. Blank records are left out. An unclosed quote runs
    to the end of its file. Quotes must be balanced within a field; a lone quote
    in unquoted text is taken for the begin of a quoted one.
    """
    if ddl is None:
        heading = spark.read.options(header=True, multiLine=True, **QUOTING).csv(path)
        names = heading.columns
        if not names:  # nothing in the files
            return heading
        ddl = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    lines = _lines(spark, path)
    # one row per chunk; a broadcast join keeps the order of the lines
    told = lines.join(F.broadcast(_chunks(lines)), ["file", "start"]).select("file", "start", "inside", "value")
    joined = told.mapInArrow(_join, "file string, start bigint, kind int, text string")
    # the first record of a file is its header: the first row of its first chunk
    place = F.monotonically_increasing_id()
    parsed = F.from_csv("text", ddl, QUOTING)
    whole = F.col("kind") == _WHOLE
    table = materialise(joined.select(
        "file", "start", "kind", F.when(~whole, F.col("text")).alias("piece"), F.when(whole, parsed).alias("row"),
        F.when(F.trim("text") == "", True).otherwise(False).alias("blank"), place.alias("place")), "records")
    pieces = table.where(F.col("kind") != _WHOLE).select("file", "start", "kind", F.col("piece").alias("text"))
    crossing = _stitched(pieces).select(
        "file", "start", parsed.alias("row"), (F.trim("text") == "").alias("blank"), F.lit(None).cast("bigint").alias("place"))
    rows = table.where(whole).select("file", "start", "row", "blank", "place").unionByName(crossing).where(~F.col("blank"))
    # of the rows of a chunk the crossing one comes last
    first = rows.groupBy("file").agg(F.min(F.struct("start", F.col("place").isNull().alias("late"), "place")).alias("first"))
    header = (F.col("start") == F.col("first.start")) & F.col("place").eqNullSafe(F.col("first.place"))
    return rows.join(F.broadcast(first), "file").where(~header).select("row.*")
