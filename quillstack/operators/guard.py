"""Permissions: effective folders, visible documents and guarded views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACCESS_LEVELS
from . import folders as tree


def level_rank(level: Column) -> Column:
    """read 0, write 1, admin 2; each includes those before."""
    found = F.lit(None).cast("int")
    for rank, name in enumerate(ACCESS_LEVELS):
        found = F.when(level == name, rank).otherwise(found)
    return found


def labelled(folders: DataFrame) -> DataFrame:
    """folders.labels of a folder table, or the table itself if it has them already."""
    return folders if {"low", "high"} <= set(folders.columns) else tree.labels(folders)


def folder_tree(folders: DataFrame) -> DataFrame:
    """root, id, depth for every folder that hangs from a root; roots have a null parent. folders: the table, or its labels."""
    return labelled(folders).where(~F.col("orphan")).select("root", "id", "depth")


def granted_ranges(user_roles: DataFrame, grants: DataFrame, labels: DataFrame, required: str = "read") -> DataFrame:
    """user_id, low, high: the disjoint ranges of the folder tree that each user's roles grant at `required` or above."""
    enough = grants.where(level_rank(F.col("access_level")) >= ACCESS_LEVELS.index(required))
    direct = user_roles.join(enough, "role_id").select("user_id", F.col("folder_id").alias("id")).distinct()
    return tree.outermost(direct.join(labels.select("id", "low", "high"), "id").drop("id"), ["user_id"])


def effective_folders(user_roles: DataFrame, grants: DataFrame, folders: DataFrame, required: str = "read") -> DataFrame:
    """user_id, folder_id: what each user's roles grant at `required` or above, sub-folders included.

    user_roles: user_id, role_id. grants: role_id, folder_id, access_level.
    folders: the table, or better its labels, which are made once for many queries. Folders on or below a cycle are in nobody's.
    """
    labels = labelled(folders)
    return tree.at_or_below(granted_ranges(user_roles, grants, labels, required), labels).select("user_id", F.col("id").alias("folder_id"))


def visible(docs: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents in one user's effective folders. The filter comes before any rank or limit."""
    return docs.join(folders.select("folder_id"), "folder_id", "left_semi")


def visible_or_owned(docs: DataFrame, folders: DataFrame, user_id: Column) -> DataFrame:
    """Documents in the user's effective folders or uploaded by the user."""
    granted = folders.select("folder_id", F.lit(True).alias("__granted")).distinct()
    found = docs.join(granted, "folder_id", "left").where(F.col("__granted") | (F.col("uploaded_by") == user_id))
    return found.drop("__granted")


def not_deleted(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def guarded(docs: DataFrame, user_roles: DataFrame, grants: DataFrame, folders: DataFrame, user_id: str, tenant: str | None = None) -> DataFrame:
    """The view to hand to a user: not deleted, of the tenant, and visible or owned."""
    mine = effective_folders(user_roles.where(F.col("user_id") == user_id), grants, folders)
    shown = visible_or_owned(not_deleted(docs), mine, F.lit(user_id))
    return shown if tenant is None else shown.where(F.col("organization_id") == tenant)


def register(views: dict[str, DataFrame]) -> None:
    """Makes guarded views known to SQL under their names in this session; what is registered is the guarded plan, not the table."""
    for name, view in views.items():
        view.createOrReplaceTempView(name)
