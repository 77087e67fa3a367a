"""Extraction, fraud, jobs, audit and the extra roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction, fraud, ops
from ..session import table
from .registry import query

STATES = ["click", "error", "purchase", "signup", "view"]


@query(r"""SELECT doc_id, 'email' AS field_name, v AS field_value, CASE WHEN lower(v) LIKE '%.com' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence_score
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS v FROM documents)""")
def extract_fields(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract_fields(table(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM pages")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"))


@query("""SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def typed_fields(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return texts.select("o_orderkey", (T.amount(F.col("amount")) * 100).cast("long").alias("cents"), T.iso_date(F.col("day")).cast("string").alias("day"))


@query("""SELECT l_orderkey, field_name, field_value FROM (SELECT l_orderkey, l_linenumber,
    unnest([{'n': 'quantity', 'v': l_quantity::BIGINT::VARCHAR}, {'n': 'returnflag', 'v': l_returnflag}, {'n': 'linestatus', 'v': l_linestatus}], recursive := true)
    FROM lineitem WHERE l_orderkey = 42) AS t(l_orderkey, l_linenumber, field_name, field_value)""")
def document_fields(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_orderkey = 42")
    return lines.selectExpr("l_orderkey", "stack(3, 'quantity', cast(cast(l_quantity as bigint) as string), 'returnflag', l_returnflag, 'linestatus', l_linestatus) as (field_name, field_value)")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Confidence in whole hundredths: 100 less the discount's."""
    lines = table(spark, d, "lineitem")
    return lines.withColumns({"hundredths": 100 - F.round(F.col("l_discount") * 100).cast("long"), "human_verified": F.col("l_linestatus") == "F"})


_HUNDREDTHS = "100 - CAST(round(l_discount * 100) AS BIGINT)"


@query(f"""SELECT l_orderkey, min({_HUNDREDTHS})::DOUBLE / 100 AS min_confidence, sum({_HUNDREDTHS})::DOUBLE / (count(*)::DOUBLE * 100) AS avg_confidence FROM lineitem GROUP BY 1""")
def doc_confidence(spark: SparkSession, d: str) -> DataFrame:
    return extraction.document_confidence(_fields(spark, d), "l_orderkey", "hundredths")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_HUNDREDTHS} AS hundredths FROM lineitem WHERE {_HUNDREDTHS} < 95 AND l_linestatus <> 'F'")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    queue = extraction.review_queue(_fields(spark, d), "hundredths", "human_verified", 95)
    return queue.orderBy("hundredths", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "hundredths")


@query("SELECT d.doc_id, coalesce(CAST(quality AS BIGINT), -1) AS quality, quality IS NOT NULL AS reviewed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def review_overlay(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return extraction.review_overlay(table(spark, d, "documents").select("doc_id"), reviews, "doc_id", "quality", F.lit(-1).cast("long"))


def _checksums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.checksum(F.col("text")).alias("checksum"))


@query("SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return fraud.duplicate_groups(_checksums(spark, d), "checksum", "doc_id")


_FLAGS = "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_duplicate, doc_id = min(doc_id) OVER (PARTITION BY text) AS is_first{0} FROM documents"


@query(_FLAGS.format(""))
def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    return fraud.duplicate_flags(_checksums(spark, d), "checksum", "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def metadata_mismatch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return fraud.metadata_mismatch(table(spark, d, "lineitem"), docs, "l_orderkey", "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_KNOWN = "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return fraud.known_passages(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query(_KNOWN)
def known_passage_match(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).distinct()


@query(f"""SELECT doc_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN is_duplicate THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN known THEN 0.5::DOUBLE ELSE 0 END)) AS risk_score,
    '{{"duplicate":' || is_duplicate || ',"known_passage":' || known || '}}' AS details
    FROM (SELECT f.*, k.doc_id IS NOT NULL AS known FROM ({_FLAGS.format("")}) f LEFT JOIN (SELECT DISTINCT doc_id FROM ({_KNOWN})) k ON f.doc_id = k.doc_id)""")
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    known = _passages(spark, d).select("doc_id", F.lit(True).alias("known")).distinct()
    found = fraud.duplicate_flags(_checksums(spark, d), "checksum", "doc_id").join(known, "doc_id", "left")
    return fraud.risk(found, {"duplicate": (F.col("is_duplicate"), 0.5), "known_passage": (F.coalesce("known", F.lit(False)), 0.5)}).select("doc_id", "risk_score", "details")


def _ocr_results(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as scanned documents, turns as their pages; a page's confidence is of its text's length."""
    score = (F.length("text") % 10_000).cast("double") / 10_000
    return table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("page_number"), F.col("text").alias("extracted_text"), score.alias("confidence_score"))


@query("""SELECT conv_id AS document_id, count(*) AS n_pages, min(length(text) % 10000)::DOUBLE / 10000 AS min_confidence,
    sum(length(text) % 10000)::DOUBLE / (count(*)::DOUBLE * 10000) AS avg_confidence FROM conversations GROUP BY conv_id""")
def ocr_confidence(spark: SparkSession, d: str) -> DataFrame:
    return extraction.ocr_confidence(_ocr_results(spark, d))


@query("""SELECT doc_id, lang = 'fr' OR (lang = 'de' AND doc_id % 2 = 0) AS needs_ocr FROM documents""")
def needs_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Documents as images, PDFs (every other one without a layer of text) and texts, by language."""
    docs = table(spark, d, "documents")
    kind = F.when(F.col("lang") == "fr", "image").when(F.col("lang") == "de", "pdf").otherwise("txt")
    layer = F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.col("text"))
    page = F.array(F.struct(F.lit(1).alias("page_number"), layer.alias("text")))
    return docs.select("doc_id", T.needs_ocr(kind, page).alias("needs_ocr"))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def typed_timestamps(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"))
    return texts.select("event_id", F.unix_micros(T.iso_timestamp(F.col("at"))).alias("micros"))


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = 7")
def audit_history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id = 7").orderBy("ts", "event_id").select("event_id", "ts", "event_type")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def audit_daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts), -1) AS gap_micros FROM events")
def audit_gaps(spark: SparkSession, d: str) -> DataFrame:
    return ops.gaps(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("event_id", "user_id", F.coalesce("gap_micros", F.lit(-1)).cast("long").alias("gap_micros"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_so_far FROM events")
def audit_running(spark: SparkSession, d: str) -> DataFrame:
    return ops.running(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("event_id", "user_id", "n_so_far")


@query("SELECT event_id, event_type, coalesce(c_name, 'unknown') AS name FROM events LEFT JOIN customer ON user_id = c_custkey")
def audit_with_doc(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "events").join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left")
    return joined.select("event_id", "event_type", F.coalesce("c_name", F.lit("unknown")).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90")
def json_attr_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k > 90")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{s}') AS {s}" for s in STATES) + " FROM events GROUP BY user_id")
def job_matrix(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id").pivot("event_type", STATES).agg(F.count(F.lit(1)))
    return counts.na.fill(0, STATES)


_LAST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query(_LAST)
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return ops.latest_job(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"{_LAST} AND event_type = 'error'")
def failed_jobs(spark: SparkSession, d: str) -> DataFrame:
    return latest_job(spark, d).where("event_type = 'error'")


@query("SELECT event_id, coalesce(date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), -1) AS micros FROM events")
def job_durations(spark: SparkSession, d: str) -> DataFrame:
    return ops.durations(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("event_id", F.coalesce("micros", F.lit(-1)).cast("long").alias("micros"))


@query("SELECT user_id, count(DISTINCT event_type) = 5 AS is_complete FROM events GROUP BY 1")
def pipeline_complete(spark: SparkSession, d: str) -> DataFrame:
    return ops.complete(table(spark, d, "events"), "user_id", "event_type", STATES)


@query("SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))


@query()
def approx_users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("n_users"))


@query("SELECT event_type, CAST(day AS VARCHAR) AS day, count(*) AS n FROM (SELECT event_type, CAST(ts AS DATE) AS day FROM events) GROUP BY CUBE (event_type, day)")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return days.cube("event_type", "day").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "10 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT start, count(*) AS n FROM (
    SELECT time_bucket(INTERVAL '30 minutes', ts) - o * INTERVAL '30 minutes' AS start FROM events, range(0, 2) r(o)) GROUP BY 1""")
def ext_sliding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT 'healthy' AS status, count(*) AS tables FROM (SELECT 1 FROM region LIMIT 1) UNION ALL SELECT 'running', 0")
def service_info(spark: SparkSession, d: str) -> DataFrame:
    """The root's constant and the health probe: a session that is alive and a table that can be read."""
    alive = table(spark, d, "region").limit(1).agg(F.count("*").alias("tables")).select(F.lit("healthy").alias("status"), "tables")
    return alive.union(spark.range(1).select(F.lit("running"), F.lit(0).cast("long")))
