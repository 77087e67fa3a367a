"""Structured Streaming: uploads and windows over event time; live.py follows jobs and workflows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import struct
from ..sources import ingest, sinks
from ..sources.commits import Store, fresh
from ..sources.parsers import Parser


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone; a plain one is read in the session's (UTC)."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return event_time(events).withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n")).select("window.start", "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return event_time(events).withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select("window.start", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    keyed = event_time(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return keyed.agg(F.count("*").alias("n")).select("user_id", "w.start", "n")


def fresh_uploads(uploads: DataFrame, late: str = "1 day") -> DataFrame:
    """One upload for each checksum within the watermark."""
    return uploads.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["checksum"])


def stream_name(checkpoint: str) -> str:
    """A name for a stream's batches: what their numbers count within."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def ingest_stream(spark: SparkSession, incoming: str, root: str, folders: DataFrame, checkpoint: str, uploaded_by: str, folder: str, parsers: dict[str, Parser] | None = None) -> StreamingQuery:
    """Takes in all new files once and ends: bytes, pages, OCR results, metadata, audit rows, rejects and catalog rows of each micro-batch.

    A micro-batch is one batch of the store (commits.Batch): its rows are in all tables or
    in none, and if it is tried again after it was committed, nothing is written. Ids follow from the content; files
    whose path and bytes are in the catalog already, or were rejected before, are left out at the start. If another
    stream commits uploads meanwhile, the micro-batch fails with Conflict and is tried again.
    """
    store = Store(spark, root)
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(incoming)

    def take(rows: DataFrame, number: int) -> None:
        uploads = rows.select(
            F.col("path").alias("storage_path"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("created_at"), "content", F.lit(uploaded_by).alias("uploaded_by"), F.lit(folder).alias("folder"),
        )
        batch = store.batch(stream_name(checkpoint), number)
        if batch.done:
            return
        there = batch.seen.read("documents", struct("documents")).select("storage_path", "checksum")
        unseen = uploads.withColumn("checksum", F.sha2("content", 256)).join(there, ["storage_path", "checksum"], "left_anti").drop("checksum")
        checked = ingest.validate(unseen).persist()
        accepted = checked.where("reason is null").drop("reason")
        parsed = ingest.parse(accepted, parsers).persist()
        records = ingest.normalize(parsed)
        docs, meta, homeless = ingest.catalog_rows(records, folders)
        housed = records.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        rejected = fresh(ingest.rejects(checked, parsed, homeless), batch.seen.read("rejects", struct("rejects")), ["storage_path", "reason"])
        sinks.stage_bytes(batch, fresh(accepted.select("storage_path", "content"), batch.seen.read(sinks.RAW, struct(sinks.RAW)), ["storage_path"]))
        parts = {"pages": ingest.page_rows(housed), "ocr_results": ingest.ocr_rows(housed), "document_metadata": meta, "audit_logs": ingest.upload_audit(docs), "rejects": rejected, "documents": docs}
        for table, rows in parts.items():
            sinks.stage(batch, rows, table)
        batch.commit(relies_on=("documents", "rejects", sinks.RAW))
        for df in (parsed, checked):
            df.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
