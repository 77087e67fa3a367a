"""Catalog queries. The driver tables stand in for the catalog's: orders for
documents (folder: the customer's nation), customers for users, nations and
regions for folders, lineitem for versions and fields, events for tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..session import table
from .registry import query

VERSION_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]


def with_folder(spark: SparkSession, d: str) -> DataFrame:
    """orders with the owner's nation and region."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_uploads(spark: SparkSession, d: str) -> DataFrame:
    return catalog.recent(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 20).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 7")
def my_documents(spark: SparkSession, d: str) -> DataFrame:
    mine = table(spark, d, "orders").where("o_custkey = 7")
    return mine.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def folder_browse(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "customer").where("c_nationkey = 3")
    return table(spark, d, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    return catalog.date_range(table(spark, d, "orders"), "o_orderdate", "1998-01-01", "1998-07-01").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey, s.name AS status FROM orders
    LEFT JOIN (VALUES ('F', 'approved'), ('O', 'uploaded'), ('P', 'under_review')) s(code, name) ON o_orderstatus = s.code WHERE o_orderstatus = 'P'""")
def status_filter(spark: SparkSession, d: str) -> DataFrame:
    states = spark.createDataFrame([("F", "approved"), ("O", "uploaded"), ("P", "under_review")], "code string, status string")
    docs = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return docs.join(F.broadcast(states), F.col("o_orderstatus") == F.col("code"), "left").select("o_orderkey", "status")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' ORDER BY p_name, p_partkey LIMIT 50")
def name_prefix_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.prefix_search(table(spark, d, "part"), "p_name", "red", "p_partkey", 50).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0")
def active_users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def docs_with_folder(spark: SparkSession, d: str) -> DataFrame:
    return with_folder(spark, d).select("o_orderkey", "c_name", "n_name", "r_name")


@query(r"""SELECT doc_id, n_chars, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_words, coalesce(n, 1) AS page_count, coalesce(bytes, n_chars) AS page_chars
    FROM documents LEFT JOIN (SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS bytes FROM conversations GROUP BY 1) ON doc_id = conv_id""")
def docs_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their pages' metadata, added up of page rows. Conversations' turns stand for pages of the documents with their ids; the others have one page."""
    from ..functions.text import words

    meta = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    joined = table(spark, d, "documents").join(meta, "doc_id", "left")
    return joined.select("doc_id", "n_chars", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.coalesce("n", F.lit(1)).cast("long").alias("page_count"), F.coalesce("chars", "n_chars").cast("long").alias("page_chars"))


@query("""SELECT o_orderkey, c_name, n_name, coalesce(f.n, 0) AS n_fields, f.least / 100.0::DOUBLE AS min_confidence FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(100 - CAST(round(l_discount * 100) AS BIGINT)) AS least FROM lineitem GROUP BY 1) f ON o_orderkey = f.l_orderkey""")
def document_360(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min(100 - F.round(F.col("l_discount") * 100).cast("long")).alias("least"))
    joined = with_folder(spark, d).join(fields, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "c_name", "n_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_fields"), (F.col("least").cast("double") / 100).alias("min_confidence"))


@query("""SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def record_class_filter(spark: SparkSession, d: str) -> DataFrame:
    return with_folder(spark, d).where("r_name = 'ASIA'").select("o_orderkey")


@query("""SELECT o_orderkey, n_regionkey AS organization_id FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def tenant_filter(spark: SparkSession, d: str) -> DataFrame:
    return with_folder(spark, d).where("n_regionkey = 1").select("o_orderkey", F.col("n_regionkey").alias("organization_id"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'purchase')")
def tags_any(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_any(table(spark, d, "events"), "user_id", "event_type", ["click", "purchase"])


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 2")
def tags_all(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_all(table(spark, d, "events"), "user_id", "event_type", ["click", "purchase"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_intersect(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.where("o_orderstatus = 'P'").select("o_orderkey").intersect(orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"))


_VERSIONS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate{0}, l_linenumber{0}, l_partkey{0}, l_suppkey{0})"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_VERSIONS.format('')} AS version_number FROM lineitem")
def version_numbers(spark: SparkSession, d: str) -> DataFrame:
    return catalog.version_numbers(table(spark, d, "lineitem"), "l_orderkey", VERSION_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "version_number")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, {_VERSIONS.format(' DESC')} AS r FROM lineitem) WHERE r = 1")
def current_version(spark: SparkSession, d: str) -> DataFrame:
    return catalog.current_version(table(spark, d, "lineitem"), "l_orderkey", VERSION_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT r_name, n_name, count(*) AS n, CAST(grouping(r_name) AS BIGINT) AS all_regions, CAST(grouping(n_name) AS BIGINT) AS all_nations
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    counts = with_folder(spark, d).rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping("r_name").cast("long").alias("all_regions"), F.grouping("n_name").cast("long").alias("all_nations"))
    return counts.select("r_name", "n_name", "n", "all_regions", "all_nations")


@query("SELECT source, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS n FROM documents GROUP BY 1")
def folder_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes"), F.count("*").alias("n"))


@query("SELECT DISTINCT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def index_missing_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def unindexed_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id) AS indexed FROM documents")
def indexed_flag(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id").distinct()
    return table(spark, d, "documents").join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", F.col("vec_id").isNotNull().alias("indexed"))


@query("""SELECT coalesce(doc_id, vec_id) AS doc_id, CASE WHEN vec_id IS NULL THEN 'missing' WHEN doc_id IS NULL THEN 'orphan' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT doc_id FROM documents) FULL OUTER JOIN (SELECT DISTINCT vec_id FROM embeddings) ON doc_id = vec_id""")
def index_drift(spark: SparkSession, d: str) -> DataFrame:
    return catalog.drift(table(spark, d, "documents"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
