"""What users do to documents, each with the audit rows that go with it. Logs are appended to, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from .guard import level_rank, visible_or_owned
from .ops import audit


def view(docs: DataFrame, effective: DataFrame, user: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(the documents that the user may see, audit rows of the views). effective: the user's folders."""
    shown = visible_or_owned(docs, effective, F.lit(user))
    return shown, audit(shown, "view", F.lit(user), F.col("id"), F.struct("filename"), at)


def download(docs: DataFrame, store: DataFrame, effective: DataFrame, user: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(id, content of the documents that the user may see, audit rows). store: storage_path, content."""
    shown = visible_or_owned(docs, effective, F.lit(user))
    return shown.join(store, "storage_path").select("id", "content"), audit(shown, "download", F.lit(user), F.col("id"), F.struct("filename", "checksum"), at)


def delete(docs: DataFrame, writable: DataFrame, user: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(tombstones for catalog.soft_deleted, audit rows) of the documents that the user may write. writable: effective folders at 'write'."""
    gone = visible_or_owned(docs, writable, F.lit(user))
    return gone.select("id", at.cast("timestamp").alias("deleted_at")), audit(gone, "delete", F.lit(user), F.col("id"), F.struct("filename"), at)


def change_permissions(grants: DataFrame, user: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of permissions with a known level, audit rows). grants: role_id, folder_id, access_level."""
    known = grants.where(level_rank(F.col("access_level")).isNotNull())
    rows = known.select(F.sha2(F.concat_ws("|", "role_id", "folder_id", "access_level"), 256).alias("id"), "role_id", "folder_id", "access_level")
    return rows, audit(known, "permission_change", F.lit(user), F.lit(None), F.struct("role_id", "folder_id", "access_level"), at)


def record(rows: DataFrame, root: str) -> None:
    """Appends audit rows; what is tried again adds nothing twice."""
    sinks.append_new(rows, root, "audit_logs", ["id"])
