"""The thin queries of the operators on embeddings (11 to 13), and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, embedding_dedup, hard_negatives
from .common import table


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.with_inertia(centroids.centroid_clusters(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op11_hard_negatives, op12_centroids, op13_embedding_dedup)}


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""


def _op12_sql(rounds: int = 10) -> str:
    """Every round as two tables, one of the assignments and one of the centroids that follow."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
gaps{r} AS MATERIALIZED (
  SELECT vec_id, number, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM parts JOIN centroids{r} USING (i) GROUP BY vec_id, number),
own{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(number, (distance, number)) AS number, min(distance) AS distance FROM gaps{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT number, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM parts JOIN own{r} USING (vec_id) GROUP BY number, i),
centroids{r + 1} AS MATERIALIZED (
  SELECT number, i, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM centroids{r} LEFT JOIN sums{r} USING (number, i))""")
    return f"""
WITH parts AS MATERIALIZED (
  SELECT vec_id, unnest(range(1, 65)) AS i, unnest(list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT))) AS x
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS number FROM (SELECT DISTINCT vec_id FROM parts) ORDER BY number LIMIT 8),
centroids0 AS MATERIALIZED (
  SELECT number, i, x AS c FROM parts JOIN first USING (vec_id)),{",".join(steps)},
inertia AS (
  SELECT number, CAST(sum(distance) AS BIGINT) AS one, CAST(sum(sum(distance)) OVER () AS BIGINT) AS every FROM own{rounds} GROUP BY number),
digests AS (
  SELECT number, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS digest FROM centroids{rounds} GROUP BY number)
SELECT vec_id, CAST(number AS INTEGER) AS cluster, distance, one AS cluster_inertia, every AS inertia, digest AS centroid_sha256
FROM own{rounds} JOIN inertia USING (number) JOIN digests USING (number)
"""


OP13_SQL = f"""
WITH RECURSIVE used AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM used a JOIN used b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (
  SELECT a, min(b) AS b FROM reached GROUP BY a),
degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON vec_id = degree.a LEFT JOIN least ON vec_id = least.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11_SQL, "op12_centroids": _op12_sql(), "op13_embedding_dedup": OP13_SQL}
