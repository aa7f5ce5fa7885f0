"""Quality rules: a hashed n-gram log-likelihood ratio beside a few plain counts.

Each text is read as n-grams: its words, and pairs of neighbouring word shapes
(runs of capitals, small letters, other letters and digits become one character
each, other characters stay). N-grams are hashed into ``BUCKETS`` buckets. Two
multinomials over the buckets are compared, that of trusted documents and that
of the whole corpus scaled to the same number of n-grams, both with the same
pseudo-count per bucket. A document's ratio is the mean over its n-grams of
ln(p_trusted / p_corpus); below ``MIN_RATIO`` it is dropped.

Counting reads all documents once and shuffles one row per task and bucket at
most; scoring reads them again and shuffles nothing. Only DataFrame functions
are used.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.session import materialise, working_tables

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BUCKETS = 10_000
PSEUDO_COUNT = 10.0
MIN_RATIO = -0.1
TRUSTED_DOCS = 20_000  # bound on the labelled documents that the trusted multinomial is fitted on

_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Words of a text; none if it is null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def _shapes(text: Column) -> Column:
    """The shape of each word: one character per run of letters of a kind or of digits, the rest as it is."""
    plain = F.coalesce(text, F.lit(""))
    for kind, sign in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"[\p{L}&&[^\p{Lu}\p{Ll}]]+", "x"), (r"\p{N}+", "0")):
        plain = F.regexp_replace(plain, kind, sign)
    return F.regexp_extract_all(plain, F.lit(_WORD), F.lit(0))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def buckets(text: Column, found: Column, n_buckets: int = BUCKETS) -> Column:
    """Buckets of the n-grams of a text: its words ``found``, then its pairs of word shapes."""
    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(n_buckets)).cast("int")

    pairs = _bound(_shapes(text), lambda s: F.zip_with(
        F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.size(s)), lambda a, b: bucket(a, b)))
    return F.concat(F.transform(found, lambda w: bucket(w)), pairs)


def _covered(starts: Column) -> Column:
    """Words in the windows that begin at the given rising places."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW_WORDS).alias("last")),
        lambda s, at: F.struct(
            (s["n"] + F.least(F.lit(WINDOW_WORDS), at - s["last"])).alias("n"), at.alias("last")),
        lambda s: s["n"].cast("long"))


def _window_hashes(found: Column) -> Column:
    """Hash of each window of ``WINDOW_WORDS`` words, a power of two: of pairs, of pairs of pairs and so on."""
    def wider(width: int):
        def pairs(h: Column) -> Column:
            rest = F.greatest(F.size(h) - width, F.lit(0))
            return F.zip_with(F.slice(h, 1, rest), F.slice(h, width + 1, rest), lambda a, b: F.xxhash64(a, b))
        return pairs

    hashes, width = F.transform(found, lambda w: F.xxhash64(w)), 1
    while width < WINDOW_WORDS:
        hashes, width = _bound(hashes, wider(width)), 2 * width
    return hashes


def _repeats(w: Column, hashes: Column) -> Column:
    """Rising places of the windows found twice or more: neighbours in order of hash, compared word by word."""
    def same(a: Column, b: Column) -> Column:
        # word by word: a slice would copy the whole array
        equal = [F.get(w, a["at"] + k) == F.get(w, b["at"] + k) for k in range(WINDOW_WORDS)]
        return F.coalesce(reduce(and_, equal, a["h"] == b["h"]), F.lit(False))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return _bound(ordered, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["at"])))


def repeated_words(found: Column) -> Column:
    """Words in windows of ``WINDOW_WORDS`` found twice or more among these words, the first one included."""
    none = F.lit(0).cast("long")
    return _bound(found, lambda w: F.when(F.size(w) <= WINDOW_WORDS, none).otherwise(_bound(
        _window_hashes(w),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(_repeats(w, h))))))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(_WORD))
    return _bound(lines, lambda all_lines: (F.size(all_lines) - F.size(F.array_distinct(all_lines))).cast("long"))


def log_ratios(docs: DataFrame, trusted: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio) for every bucket; ``trusted`` holds the doc_ids of trusted documents, null ones ignored.

    Of more than ``TRUSTED_DOCS`` trusted ids those with the smallest hashes are
    used. Every row of ``docs`` counts for the corpus. Without trusted n-grams
    all ratios are 0.
    """
    ids = (
        trusted.where("doc_id IS NOT NULL").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_DOCS)
        .select(F.col("doc_id").alias("trusted_id"))
    )
    grams = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left").select(
        F.col("trusted_id").isNotNull().cast("long").alias("trusted"),
        F.explode(buckets(F.col("text"), words(F.col("text")), n_buckets)).alias("bucket"))
    counted = materialise(
        grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("trusted").alias("n_trusted")), "buckets")
    every = docs.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    total = counted.agg(F.sum("n").alias("n"), F.sum("n_trusted").alias("n_trusted")).first()
    scale = (total["n_trusted"] or 0) / (total["n"] or 1)
    zero = F.lit(0).cast("long")
    seen, expected = F.coalesce("n_trusted", zero), F.coalesce("n", zero) * F.lit(scale)
    ratio = F.log((seen + PSEUDO_COUNT) / (expected + PSEUDO_COUNT)) if scale else F.lit(0.0)
    return every.join(counted, "bucket", "left").select("bucket", ratio.alias("ratio"))


def judge(docs: DataFrame, trusted: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, ratio and kept.

    ``ratio`` is the mean log-ratio of the document's n-grams, 0 without any.
    ``kept`` is false if base_failed, else whether the ratio reaches
    ``min_ratio``. Null and empty texts have no words, and fail. Rows with
    equal or null doc_id are judged each; an empty table gives none. Without
    trusted documents only the base decides. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    with working_tables():
        model = dict(log_ratios(docs, trusted).collect())  # BUCKETS numbers
    # folded into one constant array before the first row
    ratios = F.split(F.lit(",".join(repr(model[i]) for i in range(BUCKETS))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))

    def read(found: Column) -> Column:
        total = _bound(buckets(text, found), lambda b: F.struct(
            F.aggregate(b, F.lit(0.0), lambda s, i: s + F.get(ratios, i)).alias("sum"), F.size(b).alias("n")))
        return F.struct(F.size(found).cast("long").alias("n_words"), repeated_words(found).alias("n_repeat_words"), total.alias("total"))

    counts = docs.select(
        "doc_id",
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        _bound(words(F.col("text")), read).alias("read"),  # the words are found once
    ).select(
        "doc_id", "read.n_words", "word_chars", "n_symbols", "n_dup_lines", "read.n_repeat_words", F.col("read.total").alias("total"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    ratio = F.when(F.col("total.n") > 0, F.col("total.sum") / F.col("total.n")).otherwise(F.lit(0.0))
    return counts.withColumn("base_failed", failed).withColumn("ratio", ratio).withColumn(
        "kept", ~F.col("base_failed") & (F.col("ratio") >= min_ratio)).drop("total")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids of documents labelled good and not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
