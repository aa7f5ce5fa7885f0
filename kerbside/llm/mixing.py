"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, served at most
``max_epochs`` times over. A document's virtual finish time is the number of
words its queue has delivered once the document is through, divided by the
source's target. All queues are merged by one global range sort on finish
time, and the merged sequence is cut where it reaches the total budget. At
virtual time 1 each source has delivered its target, so each source's share
misses its target by less than one document of its own, plus its part of the
words that other sources could not place.

Nothing is gathered per source: a queue is split into hash ranges of a bounded
number of documents, running totals inside a range are a window, and the
ranges before it enter as one sum. The cut is a single tuple of sort keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import numbered, restored
from kerbside.operators.ordinals import with_ordinal
from kerbside.session import materialise, working_tables

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
RANGE_ROWS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(ord, source, source_size, target) per source, written.

    Sources in code point order, null last, take the weights in turn. The
    budget is ``share`` of all words; a target stops at ``max_epochs`` times
    its source's words, and the excess goes to the others by weight: one level
    per unit of weight is raised until no further source is full.
    """
    ranked = with_ordinal(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")),
        [F.col("source").asc_nulls_last()], "ord",
    )
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    ranked = materialise(
        ranked.withColumns({"weight": turn, "cap": (F.col("source_size") * max_epochs).cast("double")}), "sources"
    )
    words, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * (words or 0), 0.0
    if weight:
        level = budget / weight
        while True:
            full = F.col("cap") <= F.col("weight") * F.lit(level)
            taken, left = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
            raised = (budget - (taken or 0.0)) / left if left else level
            if raised <= level:
                break
            level = raised
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap")))


def _cut(copies: DataFrame, keys: list[str], budget: float) -> tuple | None:
    """Sort keys of the last copy within the budget, in the global order of ``keys``."""
    placed = materialise(
        copies.select(*keys).orderBy(*keys).withColumn("_part", F.spark_partition_id()), "queue"
    )
    parts = placed.groupBy("_part").agg(F.sum("size").alias("n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    crossing = parts.where(F.col("before") <= F.lit(budget)).orderBy(F.desc("_part")).first()
    if crossing is None:
        return None
    running = F.sum("size").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    inside = placed.where(F.col("_part") == crossing["_part"]).withColumn("_sum", running + crossing["before"])
    last = inside.where(F.col("_sum") <= F.lit(budget)).agg(F.max(F.struct(*keys)).alias("last")).first()["last"]
    if last is None:
        last = placed.where(F.col("_part") < crossing["_part"]).agg(F.max(F.struct(*keys)).alias("last")).first()["last"]
    return tuple(last) if last is not None else ()


def _decide(
    sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int, seed: int
) -> DataFrame:
    """Adds source_size, target and copies to (doc_id, source, size) rows; written."""
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id")))
    sized = materialise(sized.withColumn("h", shuffled), "sizes")
    targets = source_targets(sized, weights, share, max_epochs)
    budget = targets.agg(F.sum("target")).first()[0] or 0.0

    ranges = (F.col("rows") / RANGE_ROWS).cast("long") + 1
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    queued = (
        sized.join(F.broadcast(targets) if _few(targets) else targets, sized["source"].eqNullSafe(targets["source"]))
        .select(sized["doc_id"], sized["source"], "size", "h", "ord", "source_size", "target", ranges.alias("ranges"))
        .withColumn("range", F.shiftright(place * F.col("ranges"), 32))
    )
    sums = queued.groupBy("ord", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("ord").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("ord", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("ord", "range").orderBy("h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    queued = materialise(
        queued.withColumn("within", F.sum("size").over(inside)).join(sums, ["ord", "range"])
        .withColumn("served", F.col("before") + F.col("within")).drop("before", "within", "range", "ranges"),
        "served",
    )

    def finish(epoch: Column) -> Column:
        return (F.col("served") + epoch * F.col("source_size")).cast("double") / F.col("target")

    keys = ["finish", "ord", "epoch", "h", "doc_id", "size"]
    copies = (
        queued.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("finish", finish(F.col("epoch")))
    )
    last = _cut(copies, keys, budget)
    kinds = {f.name: f.dataType for f in copies.schema}
    taken = F.lit(0)
    if last:
        limit = F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, last)])
        for epoch in range(max_epochs):
            at = {"finish": finish(F.lit(epoch)), "epoch": F.lit(epoch)}
            key = F.struct(*[at.get(k, F.col(k)).cast(kinds[k]).alias(k) for k in keys])
            taken = taken + F.when((F.col("size") > 0) & (key <= limit), 1).otherwise(0)
    return queued.withColumn("copies", taken)


def _few(table: DataFrame, rows: int = 100_000) -> bool:
    """True if the (written) table of sources is small enough to go to every task."""
    return table.limit(rows + 1).count() <= rows


def mix_report(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    max_epochs: int = MAX_EPOCHS, seed: int = 1,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    ``docs`` needs doc_id, text and source; other columns are ignored. Null
    or empty texts have size 0 and are never taken. A null source is a source
    of its own, sorted last. Rows with equal doc_id are separate documents.
    An empty table gives an empty result. Runs agree whatever the partitioning.
    """
    with working_tables() as keep:
        decided = materialise(
            _decide(docs.select("doc_id", "source", word_count().alias("size")), weights, share, max_epochs, seed),
            "mix",
        )
        keep.append(decided)
    return decided.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    max_epochs: int = MAX_EPOCHS, seed: int = 1,
) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, columns unchanged.

    Same cases as ``mix_report``; untaken documents are absent. Rows with
    equal doc_id, source and size are interchangeable to the queue, and each
    gets one of their decisions.
    """
    with working_tables() as keep:
        decided = materialise(
            _decide(docs.select("doc_id", "source", word_count().alias("size")), weights, share, max_epochs, seed),
            "mix",
        )
        keep.append(decided)
    keys = ["_doc", "_source", "_size"]
    left = docs.select(
        *numbered(docs.columns), F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), word_count().alias("_size"))
    left = left.withColumn("_twin", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    right = decided.where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("size").alias("_words"), "copies")
    right = right.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_id", "_from", "_words").orderBy(F.desc("copies"))))
    same = (
        F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_source").eqNullSafe(F.col("_from"))
        & (F.col("_size") == F.col("_words")) & (F.col("_twin") == F.col("_rank"))
    )
    copied = left.join(right, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return copied.select(*restored(docs.columns))
