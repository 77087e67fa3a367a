"""The thin queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, license_scan, mixing, ngram_join, spotsigs, substring_dedup, suffix_tree, token_counts, toxicity, vector_queries
from .common import cut, fold_of, numbered, table

Query = Callable[[SparkSession, str], DataFrame]
#: Production parameter: a public byte-level vocabulary with word ends.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_tree.suffix_tree_scores(table(spark, sf_dir, "documents"), fold_of("doc_id", 7) != 2)
    return found.select("doc_id", (fold_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", F.col("mixed_score").alias("score"), "mean_context")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.edited_likeness(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.text_of(F.col("signatures")).alias("fingerprint"), spotsigs.text_of(F.col("edited_signatures")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), "near_next", "class_id",
    )


def spotsigs_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3's join of all fingerprints: each document's class of equal ones and how many classes are near to it."""
    texts, row = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    prints = cut(texts.select(F.col(row).alias("row"), F.col("doc_id"), spotsigs.signatures(F.col("text")).alias("signatures")))
    return spotsigs.near_copies(prints).join(prints.select("row", "doc_id"), "row").select("doc_id", "class_id", "n_links", "near_id")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.row_groups(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold_of("doc_id", 5) != 0))
    return toxicity.toxicity(docs, model).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.vocabulary_bytes(token_counts.read_vocabulary(VOCABULARY))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).docs


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold_of("doc_id", 4) != 2))
    return language_id.language_id(docs, model).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_suffix_tree, op3_spotsigs, spotsigs_near_copies, op4_ngram_join, op5_toxicity, op6_token_counts, op7_mixing, op8_license_scan, op9_language_id, op10_decontamination)} | vector_queries.queries()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_item", "coverage")


#: The same mix in SQL: quotas, the shards' draws, swap-or-not shuffles and the documents' places.
OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
weighed AS (
  SELECT *, CAST(CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
         2.0::DOUBLE * source_size AS "full" FROM ranked),
levels AS (
  SELECT *, "full" / weight AS own,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum("full") OVER (ORDER BY "full" / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY "full" / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
reached AS (
  SELECT (SELECT level FROM levels WHERE level < own ORDER BY own, rank LIMIT 1) AS level),
quota AS (
  SELECT l.source, l.rank, l.source_size,
         CASE WHEN r.level IS NULL THEN l."full" ELSE least(l."full", r.level * l.weight) END AS target,
         CAST(ceil(l.source_size / 256.0::DOUBLE) AS BIGINT) AS blocks
  FROM levels l, reached r),
planned AS (
  SELECT *, CASE WHEN blocks > 0 THEN CAST(floor(target / (source_size / blocks::DOUBLE) + 1e-9) AS BIGINT) ELSE 0 END AS slots FROM quota),
planned2 AS (
  SELECT *, CASE WHEN blocks > 0 THEN CAST(round(greatest(0.0, target - slots * (source_size / blocks::DOUBLE))) AS BIGINT) ELSE 0 END AS rest FROM planned),
ranges AS (
  SELECT rank, slots, coalesce(sum(slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM planned2 WHERE slots > 0),
whole AS (
  SELECT CAST(coalesce(sum(slots), 0) AS BIGINT) AS n FROM planned2),
places AS (
  SELECT n, unnest(range(0, n)) AS place FROM whole),
drawn AS (
  SELECT place // ((n + 63) // 64) AS shard, ('0x' || substr(md5(concat_ws('|', '20', 'draw', place)), 1, 12))::BIGINT % n AS u FROM places),
counted AS (
  SELECT shard, rank, count(*) AS n FROM drawn JOIN ranges ON u >= low AND u < low + slots GROUP BY shard, rank),
topped AS (
  SELECT shard, rank, sum(n) AS n FROM (
    SELECT shard, rank, n FROM counted
    UNION ALL SELECT 63, p.rank, p.slots - coalesce(g.n, 0) FROM planned2 p LEFT JOIN (SELECT rank, sum(n) AS n FROM counted GROUP BY rank) g ON p.rank = g.rank
              WHERE p.slots > coalesce(g.n, 0)) GROUP BY shard, rank),
summed AS (
  SELECT rank, shard, n, sum(n) OVER (PARTITION BY rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM topped),
opened AS (
  SELECT s.rank, unnest(range(CAST(least(s.after - s.n, p.slots) AS BIGINT), CAST(least(s.after, p.slots) AS BIGINT))) AS slot FROM summed s JOIN planned2 p ON s.rank = p.rank
  UNION ALL SELECT rank, slots FROM planned2 WHERE rest > 0),
slot AS (
  SELECT o.rank, blocks, slots, rest, slot FROM opened o JOIN planned2 p ON o.rank = p.rank),
mapped AS (
  SELECT rank, slot, CASE WHEN slot = slots THEN rest END AS words,
         list_reduce(range(1, 17), lambda x, r:
           CASE WHEN substr(md5(concat_ws('|', '20', rank, slot // blocks, r,
                  greatest(x, (('0x' || substr(md5(concat_ws('|', '20', rank, slot // blocks, r)), 1, 12))::BIGINT % blocks + blocks - x) % blocks))), 1, 1) >= '8'
                THEN (('0x' || substr(md5(concat_ws('|', '20', rank, slot // blocks, r)), 1, 12))::BIGINT % blocks + blocks - x) % blocks
                ELSE x END, slot % blocks) AS block
  FROM slot),
visits AS (
  SELECT rank, block, count(*) FILTER (WHERE words IS NULL) AS whole, max(words) AS words FROM mapped GROUP BY rank, block),
placed AS (
  SELECT s.doc_id, p.rank, s.size, p.source_size, p.target, row_number() OVER () AS nth,
         coalesce(sum(s.size) OVER (PARTITION BY p.rank ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN planned2 p ON s.source IS NOT DISTINCT FROM p.source),
cutting AS (
  SELECT *, unnest(range(CAST(start AS BIGINT) // 256, CAST(greatest(start, start + size - 1) AS BIGINT) // 256 + 1)) AS block FROM placed),
bits AS (
  SELECT c.*, v.whole, v.words, greatest(c.start - c.block * 256, 0) AS a, least(c.start + c.size - c.block * 256, 256) AS b
  FROM cutting c LEFT JOIN visits v ON c.rank = v.rank AND c.block = v.block)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN size > 0 THEN coalesce(whole * (b - a), 0) + greatest(0, least(b, coalesce(words, 0)) - a) ELSE 0 END) AS BIGINT) AS taken
FROM bits GROUP BY nth, doc_id, size, source_size, target
"""


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50),
windows AS (
  SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h FROM places),
firsts AS (
  SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS g
  FROM windows JOIN firsts USING (h) WHERE first_id < doc_id GROUP BY doc_id),
kept AS (
  SELECT words.doc_id, w, coalesce(len(g), 0) AS n,
         CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op7_mixing": OP7_SQL} | vector_queries.oracle_sql()
