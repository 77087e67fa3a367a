"""Files to normalized records, and records to the catalog's tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunks, extension, sanitize_name
from ..operators.ops import audit
from ..schema import struct
from .parsers import FORMATS, PARSERS, Parser, Unsupported, members

#: Largest file that is accepted (our choice; the model gives no number).
MAX_BYTES = 50 << 20


def files(spark: SparkSession, path: str) -> DataFrame:
    """storage_path, filename, size_bytes, created_at, content of every file under a path that Spark can read. Spark's file sources leave empty files out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.select(F.col("path").alias("storage_path"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("created_at"), "content")


def unpack(uploads: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """uploads with what containers hold in their place: files of .zip archives, messages of .mbox files; and next to an .eml message its attachments.

    A member's path is its container's, "!" and its name; other columns are the container's. Containers in containers
    stay as they are. A member over max_bytes has no content, for validate() to refuse; a broken container stays one file. Containers are
    independent, so each task streams its own.
    """
    kind = uploads.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.iloc[[k]]
                try:
                    found = list(members(row["filename"].iloc[0] or "", bytes(row["content"].iloc[0] or b""), max_bytes))
                except Exception:  # a broken container is a file that no parser knows
                    found = [(None, None, None, None)]
                for path, name, size, content in found:
                    one = row.copy()
                    if path is not None:
                        one["storage_path"], one["filename"], one["size_bytes"], one["content"] = f"{row['storage_path'].iloc[0]}!{path}", name, size, [content]
                    yield one

    return uploads.mapInPandas(run, kind)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Normalized records kept as JSON lines."""
    return spark.read.schema(struct("contract")).json(path)


def validate(uploads: DataFrame, max_bytes: int = MAX_BYTES, min_bytes: int = 1) -> DataFrame:
    """With `reason`: null if accepted, else why not."""
    kind = extension(F.col("filename"))
    reason = (
        F.when(kind.isNull() | ~F.coalesce(kind.isin(*FORMATS), F.lit(False)), "type")
        .when(F.col("size_bytes") > max_bytes, "too_large")
        .when(F.col("size_bytes") == 0, "empty")
        .when(F.col("size_bytes") < min_bytes, "too_small")
    )
    return uploads.withColumn("reason", reason)


def parse(uploads: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Accepted files with pages, the confidence of each page that came from OCR, and error: 'unsupported', or what the parser raised.

    An OCR engine is a registered parser whose pages have a confidence.
    Files are independent, so each task streams its own.
    """
    known = PARSERS | (parsers or {})
    schema = "storage_path string, filename string, size_bytes long, created_at timestamp, checksum string, uploaded_by string, folder string, pages array<struct<page_number:int,text:string>>, confidence array<double>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages, confidence, errors = [], [], []
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                try:
                    found, error = known[name.rpartition(".")[2].lower()](bytes(content)), None
                except Unsupported:
                    found, error = [], "unsupported"
                except Exception as e:  # a broken file is a result, not a failed job
                    found, error = [], f"{type(e).__name__}: {e}"[:200]
                pages.append([{"page_number": p[0], "text": p[1]} for p in found])
                confidence.append([p[2] if len(p) > 2 else None for p in found])
                errors.append(error)
            yield batch.drop(columns="content").assign(pages=pages, confidence=confidence, error=errors)

    ready = uploads.select("storage_path", "filename", "size_bytes", "created_at", F.sha2("content", 256).alias("checksum"), "uploaded_by", "folder", "content")
    return ready.mapInPandas(run, schema)


def normalize(parsed: DataFrame) -> DataFrame:
    """Parsed files as records; ids follow from the bytes' checksum and the path, so a retry makes the same ones. ocr_applied: whether some page has a confidence."""
    kinds = F.create_map(*(F.lit(x) for k, (kind, _) in FORMATS.items() for x in (k, kind)))
    types = F.create_map(*(F.lit(x) for k, (_, mime) in FORMATS.items() for x in (k, mime)))
    kind = extension(F.col("filename"))
    return parsed.where("error is null").select(
        F.sha2(F.concat_ws("|", "checksum", "storage_path"), 256).alias("document_id"),
        kinds[kind].alias("source_type"), "storage_path", F.exists("confidence", lambda c: c.isNotNull()).alias("ocr_applied"), "pages",
        F.struct("filename", types[kind].alias("mime_type"), "size_bytes", "uploaded_by", "folder", "created_at").alias("metadata"),
        "checksum", "confidence",
    )


def rejects(checked: DataFrame, parsed: DataFrame, homeless: DataFrame) -> DataFrame:
    """storage_path, reason, detail of every file that made no document: refused, not parsed, or in an unknown folder."""
    refused = checked.where("reason is not null").select("storage_path", F.lit("refused").alias("reason"), F.col("reason").alias("detail"))
    broken = parsed.where("error is not null").select("storage_path", F.lit("not_parsed"), F.col("error"))
    return refused.union(broken).union(homeless.select("storage_path", F.lit("unknown_folder"), F.col("metadata.folder")))


def catalog_rows(found: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, document_metadata, rejected): a record whose folder name is not known is rejected. folders: id, name."""
    known = folders.select(F.col("id").alias("folder_id"), F.col("name").alias("__name")).dropDuplicates(["__name"])
    joined = found.join(known, F.col("metadata.folder") == F.col("__name"), "left")
    ok = joined.where("folder_id is not null")
    docs = ok.select(
        F.col("document_id").alias("id"), sanitize_name(F.col("metadata.filename")).alias("filename"), F.col("metadata.filename").alias("original_filename"),
        extension(F.col("metadata.filename")).alias("file_type"), F.col("metadata.mime_type").alias("mime_type"), "storage_path", "checksum",
        F.col("metadata.uploaded_by").alias("uploaded_by"), "folder_id", F.lit(None).cast("string").alias("current_version_id"),
        F.lit("uploaded").alias("workflow_status_id"), F.lit(False).alias("is_deleted"),
        F.col("metadata.created_at").alias("created_at"), F.col("metadata.created_at").alias("updated_at"),
    )
    meta = ok.select(F.sha2(F.concat(F.lit("meta|"), "document_id"), 256).alias("id"), "document_id", F.col("metadata.size_bytes").alias("size_bytes"), F.size("pages").alias("page_count"), "ocr_applied", F.lit("{}").alias("custom_fields"))
    return docs, meta, joined.where("folder_id is null").drop("folder_id", "__name")


def page_rows(found: DataFrame) -> DataFrame:
    """document_id, page_number, text: the unit of citation. An empty array of pages gives none."""
    return found.select("document_id", F.inline("pages"))


def ocr_rows(found: DataFrame) -> DataFrame:
    """Rows of ocr_results: the pages that have a confidence."""
    pages = found.select("document_id", F.inline(F.arrays_zip("pages", "confidence")), F.col("metadata.created_at").alias("processed_at")).where("confidence is not null")
    key = F.concat_ws("|", F.lit("ocr"), "document_id", "pages.page_number")
    return pages.select(F.sha2(key, 256).alias("id"), "document_id", "pages.page_number", F.col("pages.text").alias("extracted_text"), F.col("confidence").alias("confidence_score"), "processed_at")


def chunk_rows(pages: DataFrame, size: int = 200, step: int = 160) -> DataFrame:
    """document_id, page_number, chunk_index, chunk."""
    return pages.select("document_id", "page_number", F.posexplode(chunks(F.col("text"), size, step)).alias("chunk_index", "chunk"))


def upload_audit(docs: DataFrame) -> DataFrame:
    return audit(docs, "upload", F.col("uploaded_by"), F.col("id"), F.struct("filename", "checksum"), F.col("created_at"))


def verify(docs: DataFrame, store: DataFrame) -> DataFrame:
    """id, intact: whether the stored bytes still have the checksum."""
    return docs.join(store, "storage_path", "left").select("id", F.coalesce(F.sha2("content", 256) == F.col("checksum"), F.lit(False)).alias("intact"))


