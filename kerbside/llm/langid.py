"""Language identification with a bit-sliced Bloom filter of n-grams.

The filter holds the most frequent letter n-grams of every language. A slot
of the filter is a bit mask with one bit per language, so the conjunction of
the slots that an n-gram hashes to names all languages containing it, in a
single lookup for all of them. Per text, the bits are counted by language,
the counts are corrected for the false positives that the fill of each
language's slice predicts, and divided by the share of its own text that the
language's n-grams cover. The language with the largest such rate wins.

The filter is fitted on a bounded sample: about ``SAMPLE_DOCS`` whole documents
per language, drawn by a hash of doc_id, for every label there is. Everything
else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import numbered, numbered_schema, restored, small_batches
from kerbside.session import materialise, working_tables

N = 4
GRAMS = 2000
SAMPLE_DOCS = 4000
SLOTS_LOG2 = 17
HASHES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
UNKNOWN = "und"
MIN_RATE = 0.2         # of n-grams known, for a text to read like a language
MIN_GRAMS = 40         # shorter texts are not judged by it
_PER_SLICE = 64
# A-Z to a-z; other ASCII bytes than letters separate words; the bytes of other characters stay
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


class Model(NamedTuple):
    """Languages in order, their slots in slices of 64, false-positive rate and coverage per language."""

    languages: list[str]
    slices: list[np.ndarray]
    false_rate: np.ndarray
    coverage: np.ndarray


def held_out() -> Column:
    """True for one row in five, by the checksum of doc_id (a null id trains)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _grams(text: str) -> np.ndarray:
    """Codes of the ``N``-byte pieces of the words of a text, one space around each word."""
    folded = b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_FOLD).split(), b""])
    data = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(data) < N:
        return np.zeros(0, np.uint32)
    codes = data[: len(data) - N + 1].copy()
    for j in range(1, N):
        codes |= data[j:len(data) - N + 1 + j] << np.uint32(8 * j)
    return codes


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    return [(codes * np.uint32(h)) >> np.uint32(32 - SLOTS_LOG2) for h in HASHES]


def fit(labelled: DataFrame) -> Model:
    """Fit the filter on rows with text, lang and doc_id; null texts and labels are left out."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = (
        labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    )
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000.0) * SAMPLE_DOCS / F.col("n")
    sample = small_batches(labelled.join(F.broadcast(sizes), "lang").where(draw).select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes.setdefault(lang, []).append(_grams(text))
            for lang, found in codes.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"])

    with working_tables():
        counted = materialise(
            sample.mapInArrow(count, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
        totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
        top = counted.withColumn("rank", rank).where(F.col("rank") <= GRAMS).select("lang", "gram", "n").toPandas()
    languages = sorted(totals)
    slices, false_rate, coverage = [], np.zeros(len(languages)), np.ones(len(languages))
    for k in range(0, len(languages), _PER_SLICE):
        width = min(_PER_SLICE, len(languages) - k)
        slots = np.zeros(1 << SLOTS_LOG2, np.dtype(f"u{next(b for b in (1, 2, 4, 8) if 8 * b >= width)}"))
        for bit in range(width):
            rows = top[top["lang"] == languages[k + bit]]
            for at in _slots(rows["gram"].to_numpy().astype(np.uint32)):
                slots[at] |= slots.dtype.type(1 << bit)
            fill = np.count_nonzero(slots & slots.dtype.type(1 << bit)) / len(slots)
            false_rate[k + bit] = fill ** len(HASHES)
            coverage[k + bit] = rows["n"].sum() / totals[languages[k + bit]]
        slices.append(slots)
    return Model(languages, slices, false_rate, coverage)


def _rates(model: Model, codes: np.ndarray) -> np.ndarray:
    """Per language the corrected share of n-grams it contains, relative to its own text."""
    first, *others = _slots(codes)
    hits = []
    for k, slots in enumerate(model.slices):
        masks = slots[first]
        for at in others:
            masks &= slots[at]
        width = min(_PER_SLICE, len(model.languages) - k * _PER_SLICE)
        hits += [np.count_nonzero(masks & masks.dtype.type(1 << bit)) for bit in range(width)]
    share = (np.array(hits) / len(codes) - model.false_rate) / (1 - model.false_rate)
    return np.clip(share, 0, None) / np.maximum(model.coverage, 1e-9)


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, numbered, with ``lang_pred``, ``score``, ``rate``, ``grams``.

    ``score`` is the winner's part of all languages' rates, ``rate`` the
    winner's rate (near 1 for ordinary text of that language), ``grams`` the
    number of n-grams read. Texts that are
    null or have no letter, and all texts if nothing was learned, are ``und``
    with score 0. Ties go to the language first in order. Only the text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    rows = docs.select(*numbered(keep), *([] if "text" in keep else ["text"]))
    place = keep.index("text") if "text" in keep else len(keep)
    names = [*rows.columns[:len(keep)], "lang_pred", "score", "rate", "grams"]

    def predict(model: Model, text: str | None) -> tuple[str, float, float, int]:
        if not text or not model.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, 0
        codes = _grams(text)
        rates = _rates(model, codes) if len(codes) else np.zeros(len(model.languages))
        best, total = int(np.argmax(rates)), rates.sum()
        return model.languages[best], float(rates[best] / total) if total else 0.0, float(rates[best]), len(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            found = [predict(model, t) for t in batch.column(place).to_pylist()]
            lang, score, rate, grams = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))]
                + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()),
                   pa.array(grams, pa.int64())],
                names)

    return small_batches(rows).mapInArrow(
        run, f"{numbered_schema(docs, keep)}lang_pred string, score double, rate double, grams bigint")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; fitted on the rows not held out.

    Rows with equal doc_id are predicted each. An empty table, or one without
    labels, teaches nothing, and every text is ``und``.
    """
    found = identify(docs, fit(docs.where(~held_out())), ["doc_id"]).withColumnRenamed("_kept_0", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_rate: float = MIN_RATE) -> DataFrame:
    """The documents whose text reads like one of the learned languages, columns unchanged.

    Texts without a letter go, and those of ``MIN_GRAMS`` n-grams or more of
    which even the best language knows fewer than ``min_rate`` of the share
    that it knows of its own text. Shorter texts stay: too little to judge. If
    no document has a label, nothing can be learned, and all documents stay.
    """
    model = fit(docs.where(~held_out()))
    if not model.languages:
        return docs
    found = identify(docs, model, docs.columns)
    reads = (F.col("grams") < MIN_GRAMS) | (F.col("rate") >= min_rate)
    kept = (F.col("lang_pred") != UNKNOWN) & reads
    return found.where(kept).select(*restored(docs.columns))
