"""Queries over time and trust: versions in force, jobs at once, sketches, calibrated confidences. The audit log stands for
what its name says; purchases stand for new versions of a user's document, actions for jobs that run until the user's next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, extraction, hashtree, near, ops, sketches
from ..schema import JOB_TYPES
from ..session import table
from .registry import query


@query("""WITH versions AS (SELECT user_id, ts AS since, max(event_id) AS version_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT event_id, coalesce(version_id, -1) AS version_id FROM events ASOF LEFT JOIN versions ON events.user_id = versions.user_id AND events.ts >= versions.since""")
def version_in_force(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    versions = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("version_id"))
    return catalog.in_force(events.drop("event_type"), versions, "user_id", "ts", "since").select("event_id", F.coalesce("version.version_id", F.lit(-1)).alias("version_id"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window as W

    after = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_type", "ts", after.alias("ended"))


_RUNNING = """WITH jobs AS (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended FROM events),
    steps AS (SELECT event_type, ts AS t, 1 AS d FROM jobs WHERE ended IS NULL OR ended > ts UNION ALL SELECT event_type, ended, -1 FROM jobs WHERE ended > ts),
    moments AS (SELECT event_type, t, sum(d) AS d FROM steps GROUP BY 1, 2),
    running AS (SELECT event_type, t, CAST(sum(d) OVER (PARTITION BY event_type ORDER BY t) AS BIGINT) AS running FROM moments WHERE d <> 0)"""


@query(f"{_RUNNING} SELECT event_type, max(running) AS peak, arg_max(t, (running, -epoch_us(t))) AS at FROM running GROUP BY 1")
def job_peaks(spark: SparkSession, d: str) -> DataFrame:
    return ops.peaks(ops.concurrency(_jobs(spark, d), "event_type", "ts", "ended"), "event_type")


@query(f"{_RUNNING} SELECT event_type, t AS at, running FROM running")
def job_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return ops.concurrency(_jobs(spark, d), "event_type", "ts", "ended")


def daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    gaps = ops.gaps(table(spark, d, "events"), ["user_id"], "ts", "event_id")
    return sketches.daily(gaps, ["event_type"], "ts", "user_id", "user_id", "gap_micros")


@query()
def viewers_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users, gaps and the most frequent users of each month, from the days' sketches alone; tests hold them against the log."""
    month = F.date_trunc("month", "day").cast("date").cast("string").alias("month")
    found = sketches.rolled(daily_sketches(spark, d), [month, F.col("event_type")])
    return found.select(
        "month", "event_type", "n", sketches.viewers(F.col("viewers")).alias("n_users"), sketches.gap_at(F.col("gaps"), 0.5).alias("gap_median"), sketches.gap_at(F.col("gaps"), 0.9).alias("gap_90"),
        F.array_join(F.transform(F.slice("frequent", 1, 5), lambda x: x["item"]), " ").alias("most_active"), "missed",
    )


_TEXTS = "(SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)"
_DIGITS = "list_transform(range(1, 17), lambda i: CAST(v[i] AS BIGINT) * (CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END))"
#: The rules of extraction.FIELD_RULES in SQL: name, pattern, what is kept, confidence in hundredths.
_SQL_RULES = [
    ("email", extraction.EMAIL, 0, "true", "CASE WHEN lower(v) LIKE '%.com' THEN 90 ELSE 70 END"),
    ("card", extraction.CARD, 1, "len(v) = 16", f"CASE WHEN list_sum(list_transform({_DIGITS}, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0 THEN 95 ELSE 40 END"),
    ("address", extraction.ADDRESS, 1, "len(string_split(v, '.')) = 4", "CASE WHEN len(list_filter(string_split(v, '.'), lambda x: CAST(x AS BIGINT) > 255)) = 0 THEN 90 ELSE 20 END"),
    ("secret", extraction.SECRET, 1, "true", "CASE WHEN len(v) IN (32, 40, 64) THEN 95 ELSE 60 END"),
    ("amount", extraction.AMOUNT, 1, "true", "CASE WHEN contains(v, ',') THEN 90 ELSE 60 END"),
    ("date", extraction.DATE, 1, "true", "CASE WHEN TRY_CAST(v AS DATE) IS NOT NULL THEN 95 ELSE 10 END"),
    ("phone", extraction.PHONE, 1, "true", "80"),
]
_FOUND = "found AS (" + " UNION ALL ".join(f"""SELECT kind, id, '{name}' AS field_name, v AS field_value, CAST({hundredths} AS BIGINT) AS hundredths
    FROM (SELECT kind, id, unnest(regexp_extract_all(text, '{pattern}', {group})) AS v FROM texts) WHERE {kept}""" for name, pattern, group, kept, hundredths in _SQL_RULES) + ")"  # fmt: skip


def found_fields(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    texts = docs.union(table(spark, d, "pages").select(F.lit("page"), "page_id", "html"))
    found = extraction.extract_fields(texts, ["kind", "id"], "text", extraction.FIELD_RULES)
    return found.select("kind", "id", "field_name", "field_value", F.round(F.col("confidence_score") * 100).cast("long").alias("hundredths"))


@query(f"WITH texts AS {_TEXTS}, {_FOUND} SELECT * FROM found")
def all_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every rule over all documents and pages."""
    return found_fields(spark, d)


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Length of a text as its raw score, in hundredths of the longest that counts, and the review's verdict on it."""
    score = F.least(F.floor(F.length("text") / 50), F.lit(100)).cast("long")
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("rule"), score.alias("hundredths"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("right")), "doc_id")


@query("""WITH reviewed AS (SELECT lang AS rule, least(len(text) // 50, 100) AS hundredths, quality AS good FROM documents JOIN labels USING (doc_id)),
    bins AS (SELECT rule, hundredths, count(*) AS n, sum(good) AS good FROM reviewed GROUP BY 1, 2),
    sums AS (SELECT rule, hundredths, sum(n) OVER w AS n, sum(good) OVER w AS good, n AS own, good AS own_good FROM bins WINDOW w AS (PARTITION BY rule ORDER BY hundredths)),
    spans AS (SELECT a.rule, a.hundredths AS first, b.hundredths AS last, CAST(b.good - a.good + a.own_good AS BIGINT)::DOUBLE / CAST(b.n - a.n + a.own AS BIGINT)::DOUBLE AS mean
              FROM sums a JOIN sums b ON a.rule = b.rule AND a.hundredths <= b.hundredths),
    least_of AS (SELECT s.rule, s.first, c.hundredths, min(s.mean) AS mean FROM spans s JOIN bins c ON s.rule = c.rule AND s.first <= c.hundredths AND c.hundredths <= s.last GROUP BY 1, 2, 3)
    SELECT rule, hundredths, max(mean) AS confidence FROM least_of GROUP BY 1, 2""")
def calibrated_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Isotonic confidences for each rule from reviews. Labels stand for reviews, the text's length for the rules' raw score, languages for rules."""
    return extraction.calibration(_reviewed(spark, d), "rule", "hundredths", "right").select("rule", "hundredths", "confidence")


@query()
def near_duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose visible texts have SimHashes within 3 bits; tests hold it against all pairs."""
    pages = table(spark, d, "pages").select("page_id", near.visible_text(F.col("html")).alias("text"))
    return near.near_duplicates(pages, "page_id", "text")


@query("""WITH jobs AS (SELECT user_id, event_id, ts, ['ocr', 'embedding', 'extraction', 'fraud_check'][CAST(event_id % 4 AS INTEGER) + 1] AS job,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' ELSE 'done' END AS status FROM events),
    last AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY user_id, job ORDER BY ts DESC, event_id DESC) = 1),
    counts AS (SELECT user_id, count(*) FILTER (WHERE status = 'done') AS n_done, count(*) FILTER (WHERE status = 'failed') AS n_failed FROM last GROUP BY 1)
    SELECT *, CASE WHEN n_failed > 0 THEN 'failed' WHEN n_done = 4 THEN 'indexed' ELSE 'processing' END AS processing FROM counts""")
def processing_status(spark: SparkSession, d: str) -> DataFrame:
    """How far each document is. Users stand for documents, event ids and types for jobs and their statuses."""
    kinds = F.create_map(*(F.lit(x) for pair in (("error", "failed"), ("signup", "pending"), ("click", "running")) for x in pair))
    job = F.element_at(F.array(*map(F.lit, JOB_TYPES)), (F.col("event_id") % 4 + 1).cast("int"))
    log = table(spark, d, "events").select("user_id", "event_id", "ts", job.alias("job"), F.coalesce(kinds[F.col("event_type")], F.lit("done")).alias("status"))
    return ops.progress(log, "user_id", "job", "status", ["ts", "event_id"], list(JOB_TYPES))


@query("""WITH a AS (SELECT DISTINCT doc_id AS id FROM documents), b AS (SELECT DISTINCT vec_id AS id FROM embeddings)
    SELECT coalesce(a.id, b.id) // 64 AS node, count(a.id) AS n_expected, count(b.id) AS n_indexed FROM a FULL OUTER JOIN b ON a.id = b.id
    GROUP BY 1 HAVING count(*) FILTER (WHERE a.id IS NULL OR b.id IS NULL) > 0""")
def drift_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ranges of 64 ids in which catalog and index differ, by their hash trees."""
    leaf = F.floor(F.col("id") / 64)
    a = hashtree.tree(table(spark, d, "documents").select(F.col("doc_id").alias("id")).distinct(), leaf, F.col("id"))
    b = hashtree.tree(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).distinct(), leaf, F.col("id"))
    return hashtree.differing(a, b).select("node", F.col("n_a").alias("n_expected"), F.col("n_b").alias("n_indexed"))


@query("""WITH a AS (SELECT DISTINCT doc_id AS id FROM documents), b AS (SELECT DISTINCT vec_id AS id FROM embeddings)
    SELECT id, 'missing' AS status FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'orphan' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def drift_rows(spark: SparkSession, d: str) -> DataFrame:
    """The ids that only the catalog or only the index has; ranges that agree are left out before the join."""
    leaf = F.floor(F.col("id") / 64)
    expected, indexed = table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    trees = [hashtree.tree(x.distinct(), leaf, F.col("id")) for x in (expected, indexed)]
    return hashtree.drift(expected, indexed, "id", leaf, hashtree.differing(*trees))
