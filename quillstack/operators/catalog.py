"""Listing, search, versions, tags and roll-ups of a document catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordered import Ordered


def recent(docs: DataFrame, when: str, key: str, limit: int) -> DataFrame:
    """The latest documents; ties go to the smaller key."""
    return docs.orderBy(F.col(when).desc(), key).limit(limit)


def date_range(docs: DataFrame, when: str, first: str, after: str) -> DataFrame:
    """Half-open: from `first` on, before `after`."""
    return docs.where((F.col(when) >= F.lit(first).cast("timestamp_ntz")) & (F.col(when) < F.lit(after).cast("timestamp_ntz")))


def prefix_search(docs: DataFrame, name: str, prefix: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Names that start with the prefix, in order, a page at a time; the prefix is pushed to the scan."""
    return docs.where(F.col(name).startswith(prefix)).orderBy(name, key).offset(offset).limit(limit)


def with_any(tags: DataFrame, key: str, tag: str, wanted: list[str]) -> DataFrame:
    """Keys that have one of the tags."""
    return tags.where(F.col(tag).isin(wanted)).select(key).distinct()


def with_all(tags: DataFrame, key: str, tag: str, wanted: list[str]) -> DataFrame:
    """Keys that have every one of the tags."""
    return tags.where(F.col(tag).isin(wanted)).groupBy(key).agg(F.countDistinct(tag).alias("__n")).where(F.col("__n") == len(set(wanted))).select(key)


def version_numbers(versions: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Dense numbers from 1 in each document, in the given order."""
    return versions.withColumn("version_number", F.row_number().over(W.partitionBy(doc).orderBy(*order)).cast("long"))


def current_version(versions: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """The last version of each document; a document's losers are dropped before the shuffle."""
    latest = W.partitionBy(doc).orderBy(*(F.col(c).desc() for c in order))
    return versions.withColumn("__rank", F.row_number().over(latest)).where("__rank = 1").drop("__rank")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def drift(expected: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """key, status: 'ok', 'missing' (not indexed) or 'orphan' (indexed without a document)."""
    a = expected.select(F.col(key).alias("a")).distinct()
    b = indexed.select(F.col(key).alias("b")).distinct()
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").otherwise("ok")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), status.alias("status"))


def in_force(rows: DataFrame, versions: DataFrame, key: str, at: str, since: str, name: str = "version") -> DataFrame:
    """rows with `name`: the struct of the version of their key that was in force at their time, the last that began no later; null if there was none.

    An as-of join without a window for each key: rows and versions are put in one order by key and time, a
    version before the rows of its moment, and the last version seen is carried on, across the ranges of a key with very many rows. Of versions
    that began at once the one whose other columns sort last counts. A row without key or time has no version.
    """
    payload = [c for c in versions.columns if c not in (key, since)]
    old = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("__key"), F.col(since).alias("__at"), F.lit(0).alias("__side"), F.struct(key, since, *payload).alias("__version"))
    old = old.groupBy("__key", "__at", "__side").agg(F.max("__version").alias("__version")).withColumn("__row", F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType))
    new = rows.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(old.schema["__version"].dataType).alias("__version"), F.struct("*").alias("__row"))
    line = Ordered(old.unionByName(new), ["__key", "__at", "__side"]).with_last(F.when(F.col("__side") == 0, F.struct("__key", "__version")), "__last")
    fits = (F.col("__last")["__key"] == F.col("__key")) & F.col("__at").isNotNull()
    return line.where("__side = 1").select("__row.*", F.when(fits, F.col("__last")["__version"]).alias(name))


def soft_deleted(docs: DataFrame, tombstones: DataFrame, key: str, when: str) -> DataFrame:
    """Latest of each document's rows and tombstones wins: is_deleted is appended, never updated."""
    rows = docs.select(key, when, F.lit(False).alias("is_deleted")).union(tombstones.select(key, when, F.lit(True)))
    return first_of(rows, [key], [F.col(when).desc(), F.col("is_deleted").desc()])
