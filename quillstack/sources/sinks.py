"""Tables on a shared file system: append-only logs, derived tables, raw bytes. All but the derived vectors are committed by manifests (commits.Store)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import struct
from .commits import Batch, Conflict, Store, declared, fresh

#: The table of raw files, and how often a batch is tried again after others'.
RAW, ATTEMPTS = "raw", 5


def append(df: DataFrame, root: str, table: str) -> None:
    """Adds rows to one of the declared tables, in a batch of their own. Nothing here rewrites a log."""
    batch = Store(df.sparkSession, root).batch()
    stage(batch, df, table)
    batch.commit()


def stage(batch: Batch, df: DataFrame, table: str) -> None:
    """Rows of a declared table as a part of a batch; columns are put in the declared order and types."""
    batch.stage(declared(df, struct(table)), table)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The committed rows of a declared table, with its declared schema; nothing is inferred."""
    return Store(spark, root).snapshot().read(table, struct(table))


def append_new(df: DataFrame, root: str, table: str, keys: list[str]) -> None:
    """Appends the rows whose keys are not in the table, one for each key. Of two at once the later one is tried again, so that no key gets in twice."""
    store = Store(df.sparkSession, root)
    for _ in range(ATTEMPTS):
        batch = store.batch()
        stage(batch, fresh(df, batch.seen.read(table, struct(table)), keys), table)
        try:
            batch.commit(relies_on=(table,))
            return
        except Conflict:
            continue
    raise Conflict(f"{table} was changed by others {ATTEMPTS} times")


def stage_bytes(batch: Batch, files: DataFrame) -> None:
    """Raw files as a part of a batch, keyed by storage_path."""
    batch.stage(files.select("storage_path", "content").dropDuplicates(["storage_path"]), RAW)


def put_bytes(files: DataFrame, root: str) -> None:
    """Adds raw files, keyed by storage_path; a path that is there already is not written again."""
    store = Store(files.sparkSession, root)
    for _ in range(ATTEMPTS):
        batch = store.batch()
        stage_bytes(batch, fresh(files.select("storage_path", "content"), batch.seen.read(RAW, struct(RAW)), ["storage_path"]))
        try:
            batch.commit(relies_on=(RAW,))
            return
        except Conflict:
            continue
    raise Conflict(f"{RAW} was changed by others {ATTEMPTS} times")


def get_bytes(spark: SparkSession, root: str) -> DataFrame:
    return Store(spark, root).snapshot().read(RAW, struct(RAW))


def rebuild_vectors(chunks: DataFrame, root: str) -> None:
    """Makes the derived vector table anew from chunks: document_id, page_number, chunk_index, embedding. The same chunks give the same table."""
    chunks.select("document_id", "page_number", "chunk_index", "embedding").write.mode("overwrite").parquet(f"{root}/vectors")


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The derived vector table: document_id, page_number, chunk_index, embedding."""
    return spark.read.parquet(f"{root}/vectors")


def index_rows(chunks: DataFrame, at: str) -> DataFrame:
    """Pointer rows for embedding_index; the vector's key is its reference."""
    key = F.concat_ws("/", "document_id", "page_number", "chunk_index")
    return chunks.select(F.sha2(key, 256).alias("id"), "document_id", "page_number", "chunk_index", key.alias("vector_db_ref"), F.lit(at).cast("timestamp").alias("indexed_at"))
