"""One query per operator over the given tables, with checking SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from kerbside.llm import (
    decontaminate, langid, mixing, personal, quality, repeats, search, secrets, simhash, token_shards, vectors, warc,
    whitening,
)
from kerbside.llm.common import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mixing.mix_report(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


# The level is set by the sources that are not full: of all cuts of the sources in order of cap / weight,
# the first whose level does not reach the next source's cap.
ORACLES["op1_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []))::BIGINT AS size,
         md5('1:' || doc_id) AS h FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][(ord % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM sources),
cuts AS (
  SELECT *, cap / weight AS ratio,
         1.5 * sum(source_size) OVER ()::DOUBLE AS budget,
         coalesce(sum(cap) OVER w, 0) AS full_caps, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM weighted WINDOW w AS (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min_by((budget - full_caps) / open_weight, ratio) AS level FROM cuts
  WHERE (budget - full_caps) / open_weight <= ratio),
targets AS (SELECT w.*, least(weight * level, cap)::DOUBLE AS target FROM weighted w, level),
queued AS (
  SELECT doc_id, size, h, ord, source_size, target,
         sum(size) OVER (PARTITION BY ord ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
copies AS (
  SELECT *, (served + epoch * source_size)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0),
merged AS (
  SELECT doc_id, size, h, ord,
         sum(size) OVER (ORDER BY finish, ord, epoch, h, doc_id, size ROWS UNBOUNDED PRECEDING)
           <= (SELECT sum(target) FROM targets) AS fits FROM copies)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN (SELECT doc_id, sum(size) AS taken FROM merged WHERE fits GROUP BY doc_id) t USING (doc_id)
"""


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document."""
    return secrets.report(documents(spark, sf_dir))


@query
def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage located in a replica of the pages' WARC files, of which one record in 64 is damaged."""
    return warc.trial(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLES["op3_warc_audit"] = r"""
WITH marked AS (
  SELECT page_id, html, md5(page_id::VARCHAR) AS mark, strlen(coalesce(html, '')) AS size,
         regexp_replace(coalesce(url, ''), '[\x00-\x20]', '_', 'g') AS url FROM pages),
placed AS (
  SELECT *, ('0x' || substr(mark, 1, 8))::BIGINT % (SELECT 1 + sum(size) // 8388608 FROM marked) AS shard,
         -- the field names, separators and fixed values of a record, and the two blank lines
         191 + 64 + strlen(page_id::VARCHAR) + strlen(url) + length(size::VARCHAR) + size AS length FROM marked)
SELECT page_id, shard::BIGINT AS shard, "offset"::BIGINT AS "offset", length::BIGINT AS length,
       CASE WHEN mark[1:2] IN ('00', '40') THEN 'changed' ELSE 'unreadable' END AS status
FROM (SELECT *, coalesce(sum(length) OVER (
        PARTITION BY shard ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM placed)
WHERE size > 0 AND mark[1:2] IN ('00', '40', '80', 'c0')
"""


@query
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the token shards written from the documents, one row per sequence."""
    return token_shards.write_shards(documents(spark, sf_dir), token_shards.shard_path(spark))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in each document."""
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op5_decontaminate"] = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT *, least(10, len(words)) AS size FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item, size, array_to_string(words[i : i + size - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM sized)),
places AS (
  SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS w
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM folded, (SELECT DISTINCT size FROM sized))),
found AS (SELECT doc_id, i, p.size, item FROM places p JOIN windows USING (w, size)),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document once repeated windows of 20 words are removed."""
    return repeats.report(documents(spark, sf_dir))


ORACLES["op6_repeats"] = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - 18)) AS i FROM split)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS turn FROM windows)
  WHERE turn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
places AS (SELECT doc_id, k, words[k] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM split)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS words
  FROM places ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, coalesce(len(s.words), 0)::BIGINT AS n_words,
       (coalesce(len(s.words), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    return langid.report(documents(spark, sf_dir))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of each document by SimHash."""
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document."""
    return personal.report(documents(spark, sf_dir))


@query
def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of each embedding by cosine."""
    return vectors.components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# No pair has a cosine within 1e-6 of the threshold, so summation order does not matter.
ORACLES["op10_vectors"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN counted USING (vec_id)
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading whitened components of each embedding."""
    white = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))  # null beyond 64 bits


@query
def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_search"] = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
total AS (SELECT count(*) AS n, sum(len(words))::BIGINT AS l FROM folded WHERE len(words) > 0),
counted AS (
  SELECT doc_id, len(words) AS size, term, count(*) AS tf
  FROM (SELECT doc_id, words, unnest(words) AS term FROM folded) GROUP BY doc_id, words, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, total GROUP BY term, n),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l))) AS impact
  FROM counted JOIN weights USING (term), total),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict on each document; documents labelled good and not toxic are trusted."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(documents(spark, sf_dir), quality.trusted_ids(labels))
