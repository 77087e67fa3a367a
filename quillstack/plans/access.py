"""Permission queries for user 7. Roles are the market segments in order; role i
holds a grant on nation folder k where k % 5 = i, at read, write or admin by
k % 3, and read on region folder i; grants inherit downwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import folders as tree
from ..operators import guard
from ..session import table
from .registry import query

USER = 7


def roles(spark: SparkSession, d: str) -> DataFrame:
    """role, role_id: the few distinct segments, numbered from 0."""
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("role")).distinct()
    return segments.withColumn("role_id", (F.row_number().over(W.orderBy("role")) - 1).cast("long"))


def memberships(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    return users.join(roles(spark, d), "role").select("user_id", "role_id")


def folders(spark: SparkSession, d: str) -> DataFrame:
    """id, parent_folder_id: regions as roots, nations below."""
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_folder_id"))
    return roots.union(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))


#: The folder trees' labels by session and tables: like an index they are made when folders are, not for each query.
_LABELS: dict[tuple[str, str], DataFrame] = {}


def labels(spark: SparkSession, d: str) -> DataFrame:
    key = spark.sparkContext.applicationId, d
    if key not in _LABELS:
        _LABELS[key] = tree.labels(folders(spark, d))
    return _LABELS[key]


def grants(spark: SparkSession, d: str) -> DataFrame:
    """role_id, folder_id, access_level by the rule above."""
    level = F.element_at(F.array(*map(F.lit, ("read", "write", "admin"))), F.col("n_nationkey") % 3 + 1)
    nations = table(spark, d, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("role_id"), F.concat(F.lit("n"), "n_nationkey").alias("folder_id"), level.alias("access_level"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("long"), F.concat(F.lit("r"), "r_regionkey"), F.lit("read"))
    return nations.union(regions).join(roles(spark, d).select("role_id"), "role_id", "left_semi")


def documents(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("folder_id"))
    docs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("uploaded_by"))
    return docs.join(owners, F.col("uploaded_by") == F.col("c_custkey")).drop("c_custkey")


def mine(spark: SparkSession, d: str) -> DataFrame:
    return guard.effective_folders(memberships(spark, d).where(F.col("user_id") == USER), grants(spark, d), labels(spark, d))


_ROLES = """roles AS (SELECT role, row_number() OVER (ORDER BY role) - 1 AS role_id FROM (SELECT DISTINCT c_mktsegment AS role FROM customer)),
    members AS (SELECT c_custkey AS user_id, role_id FROM customer JOIN roles ON c_mktsegment = role),
    grants AS (SELECT n_nationkey % 5 AS role_id, 'n' || n_nationkey AS folder_id, ['read', 'write', 'admin'][n_nationkey % 3 + 1] AS access_level FROM nation
        UNION ALL SELECT r_regionkey, 'r' || r_regionkey, 'read' FROM region),
    mine AS (SELECT DISTINCT g.folder_id FROM members m JOIN grants g ON m.role_id = g.role_id WHERE user_id = 7),
    effective AS (SELECT folder_id FROM mine UNION SELECT 'n' || n_nationkey FROM nation JOIN mine ON folder_id = 'r' || n_regionkey),
    docs AS (SELECT o_orderkey, o_custkey, 'n' || c_nationkey AS folder_id FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {_ROLES} SELECT user_id, CAST(role_id AS BIGINT) AS role_id FROM members")
def user_roles(spark: SparkSession, d: str) -> DataFrame:
    return memberships(spark, d)


@query(f"WITH {_ROLES} SELECT CAST(role_id AS BIGINT) AS role_id, folder_id, access_level FROM grants")
def role_grants(spark: SparkSession, d: str) -> DataFrame:
    return grants(spark, d)


@query("""SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, CAST(0 AS BIGINT) AS depth FROM region
    UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1 FROM nation""")
def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    return guard.folder_tree(labels(spark, d))


@query(f"WITH {_ROLES} SELECT folder_id FROM effective")
def rbac_effective_folders(spark: SparkSession, d: str) -> DataFrame:
    return mine(spark, d).select("folder_id")


@query(f"WITH {_ROLES} SELECT o_orderkey FROM docs WHERE folder_id IN (SELECT folder_id FROM effective)")
def rbac_visible_docs(spark: SparkSession, d: str) -> DataFrame:
    return guard.visible(documents(spark, d), mine(spark, d)).select("o_orderkey")


@query(f"WITH {_ROLES} SELECT o_orderkey FROM docs WHERE folder_id IN (SELECT folder_id FROM effective) OR o_custkey = 7")
def rbac_owner_or_grant(spark: SparkSession, d: str) -> DataFrame:
    return guard.visible_or_owned(documents(spark, d), mine(spark, d), F.lit(USER)).select("o_orderkey")
