"""Parsers of each format over files made from the driver tables: what is written into a file has to be read from it."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email.message import EmailMessage
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import ingest
from .registry import query


def zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def docx(cells: list[str]) -> bytes:
    """A paragraph for each line."""
    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in cells[0].split("\n"))
    return zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})


def pptx(cells: list[str]) -> bytes:
    """A slide for each cell."""
    return zipped({f"ppt/slides/slide{k}.xml": f'<sld xmlns:a="a"><a:p><a:r><a:t>{escape(c)}</a:t></a:r></a:p></sld>' for k, c in enumerate(cells, 1)})


def xlsx(cells: list[str]) -> bytes:
    """One row, shared strings."""
    shared = "".join(f"<si><t>{escape(c)}</t></si>" for c in cells)
    row = "".join(f'<c t="s"><v>{k}</v></c>' for k in range(len(cells)))
    return zipped({"xl/sharedStrings.xml": f"<sst>{shared}</sst>", "xl/worksheets/sheet1.xml": f"<s><row>{row}</row></s>"})


def comma(cells: list[str]) -> bytes:
    out = io.StringIO()
    csv.writer(out).writerow(cells)
    return out.getvalue().encode()


_LINE = re.compile(r"[!-~](?:(?!=\?)[ -~]){0,64}[!-~]")


def eml(cells: list[str]) -> bytes:
    if all(map(_LINE.fullmatch, cells[:2])) and "=?" not in cells[0]:  # the bytes that the email package writes
        return f'Subject: {cells[0]}\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 7bit\nMIME-Version: 1.0\n\n{cells[1]}\n'.encode()
    message = EmailMessage()
    message["Subject"] = cells[0]
    message.set_content(cells[1])
    return message.as_bytes()


def html(cells: list[str]) -> bytes:
    return f"<html><head><style>p {{}}</style></head><body>{''.join(f'<p>{escape(c)}</p>' for c in cells)}<script>x</script></body></html>".encode()


def read_back(rows: DataFrame, key: str, kind: str, make: Callable[[list[str]], bytes]) -> DataFrame:
    """key, page_number, text of the files that `make` writes from each row's `cells`, through the parsers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"name": batch[key].astype(str), "content": [make(list(c)) for c in batch["cells"]]})

    files = rows.select(key, "cells").mapInPandas(run, "name string, content binary")
    uploads = files.select(
        "name", F.concat(F.lit("local://made/"), "name").alias("storage_path"), F.concat("name", F.lit(f".{kind}")).alias("filename"), F.length("content").cast("long").alias("size_bytes"),
        F.lit("2026-01-01").cast("timestamp").alias("created_at"), F.lit("u").alias("uploaded_by"), F.lit("f").alias("folder"), "content",
    )
    found = ingest.normalize(ingest.parse(ingest.validate(uploads).where("reason is null")))
    pages = found.select(F.substring_index("storage_path", "/", -1).cast("long").alias(key), F.inline("pages"))
    return pages.withColumn("page_number", F.col("page_number").cast("long"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.array("text").alias("cells"))


def _dealt(spark: SparkSession, d: str) -> DataFrame:
    """Small rows that become a file each: a few megabytes of them, which Spark would read in one task, are much work, so that they are dealt to all cores."""
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type").repartition(8 * spark.sparkContext.defaultParallelism, "p_partkey")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return _dealt(spark, d).select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("cells"))


_TEXTS = "SELECT doc_id, CAST(1 AS BIGINT) AS page_number, text FROM documents WHERE text <> ''"
_ROWS = "SELECT p_partkey, CAST(1 AS BIGINT) AS page_number, p_name || {0} || p_brand || {0} || p_type AS text FROM part"


@query(_TEXTS)
def parse_txt(spark: SparkSession, d: str) -> DataFrame:
    return read_back(_documents(spark, d), "doc_id", "txt", lambda cells: cells[0].encode())


@query(_TEXTS)
def parse_docx(spark: SparkSession, d: str) -> DataFrame:
    return read_back(_documents(spark, d), "doc_id", "docx", docx)


@query(_ROWS.format("chr(9)"))
def parse_csv(spark: SparkSession, d: str) -> DataFrame:
    return read_back(_parts(spark, d), "p_partkey", "csv", comma)


@query(_ROWS.format("chr(9)"))
def parse_xlsx(spark: SparkSession, d: str) -> DataFrame:
    return read_back(_parts(spark, d), "p_partkey", "xlsx", xlsx)


@query("SELECT p_partkey, CAST(1 AS BIGINT) AS page_number, p_name AS text FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part UNION ALL SELECT p_partkey, 3, p_type FROM part")
def parse_pptx(spark: SparkSession, d: str) -> DataFrame:
    return read_back(_parts(spark, d), "p_partkey", "pptx", pptx)


@query("SELECT p_partkey, CAST(1 AS BIGINT) AS page_number, p_name || chr(10) || p_brand AS text FROM part")
def parse_eml(spark: SparkSession, d: str) -> DataFrame:
    return read_back(_parts(spark, d), "p_partkey", "eml", eml)


@query(_ROWS.format("chr(10)"))
def parse_html(spark: SparkSession, d: str) -> DataFrame:
    return read_back(_parts(spark, d), "p_partkey", "html", html)


def _scan(content: bytes) -> list[tuple[int, str, float]]:
    """A stand-in for an OCR engine: what it reads is the file's text, and its confidence is of the text's length."""
    text = content.decode()
    return [(1, text, len(text) % 100 / 100)]


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, p_name AS extracted_text, (length(p_name) % 100)::DOUBLE / 100 AS confidence_score, true AS ocr_applied FROM part")
def parse_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Images through a registered OCR parser: its pages' texts and confidences, as rows for ocr_results."""
    parts = _dealt(spark, d)
    uploads = parts.select(
        F.concat(F.lit("local://made/"), "p_partkey").alias("storage_path"), F.concat("p_partkey", F.lit(".png")).alias("filename"), F.length("p_name").cast("long").alias("size_bytes"),
        F.lit("2026-01-01").cast("timestamp").alias("created_at"), F.lit("u").alias("uploaded_by"), F.lit("f").alias("folder"), F.col("p_name").cast("binary").alias("content"),
    )
    found = ingest.normalize(ingest.parse(uploads, {"png": _scan}))
    names = found.select("document_id", F.substring_index("storage_path", "/", -1).alias("name"), "ocr_applied")
    return ingest.ocr_rows(found).join(names, "document_id").select("name", "extracted_text", "confidence_score", "ocr_applied")
