"""Column functions over text, names, addresses and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checksum(text: Column) -> Column:
    """SHA-256 of the bytes, as lower-case hex."""
    return F.sha2(text, 256)


def sanitize_name(name: Column) -> Column:
    """Lower case; every run of anything but a-z, 0-9, dot, underscore and hyphen becomes one underscore."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "_")


def extension(filename: Column) -> Column:
    """The lower-cased part after the last dot; null without one."""
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.element_at(F.split(filename, r"\."), -1)))


def storage_uri(uri: Column) -> Column:
    """struct(scheme, bucket, key) of local://, minio:// and s3:// paths; the parts are null if it is none."""
    parts = r"^([a-z0-9]+)://([^/]*)/?(.*)$"
    known = F.regexp_like(uri, F.lit(parts))
    return F.struct(*(F.when(known, F.regexp_extract(uri, parts, i)).alias(n) for i, n in ((1, "scheme"), (2, "bucket"), (3, "key"))))


def hadoop_path(uri: Column, local_root: str) -> Column:
    """Where Spark finds what a storage URI names: minio:// and s3:// in the S3 file system, local:// under a root; other paths as they are."""
    parts = storage_uri(uri)
    key = F.concat(parts["bucket"], F.lit("/"), parts["key"])
    return F.when(parts["scheme"].isin("minio", "s3"), F.concat(F.lit("s3a://"), key)).when(parts["scheme"] == "local", F.concat(F.lit(local_root.rstrip("/") + "/"), key)).otherwise(uri)


def structure(text: Column) -> Column:
    """'structured', 'semi' or 'unstructured', by what stands in a text.

    Tags make it semi-structured. Two lines or more that all hold the same number of tabs, semicolons or bars, one at least, are a
    table. A text half of whose lines begin with a name and a colon is semi-structured. Blank lines don't count; null and blank texts are unstructured.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    count = lambda x, d: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit("")))
    table = lambda ls, d: (count(F.get(ls, F.lit(0)), d) > 0) & F.forall(ls, lambda x: count(x, d) == count(F.get(ls, F.lit(0)), d))
    named = lambda ls: F.size(F.filter(ls, lambda x: F.regexp_like(x, F.lit("^[A-Za-z][^:\n]{0,40}: "))))
    kind = lambda ls: F.when((F.size(ls) > 1) & (table(ls, "\t") | table(ls, ";") | table(ls, "|")), "structured").when((F.size(ls) > 0) & (2 * named(ls) >= F.size(ls)), "semi")
    found = F.transform(F.array(lines), kind)[0]
    return F.coalesce(F.when(F.regexp_like(text, F.lit("<[A-Za-z!/][^>]*>")), "semi"), found, F.lit("unstructured"))


def words(text: Column) -> Column:
    """Words between runs of white space; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunks(text: Column, size: int = 200, step: int = 160) -> Column:
    """Overlapping chunks of `size` words, one every `step`: an array in order, empty for a text without words."""
    def cut(ws: Column) -> Column:
        n = F.size(ws)
        last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(ws, k * step + 1, F.lit(size)), " "))

    # bound to a lambda's variable, so that the words are split once
    return F.transform(F.array(words(text)), cut)[0]


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors in double precision, summed from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def amount(value: Column) -> Column:
    """'4,250.00' -> 4250.00 as decimal(18,2); null if it is no amount."""
    return F.try_to_number(F.regexp_replace(value, ",", ""), F.lit("999999999999999.99")).cast("decimal(18,2)")


def iso_date(value: Column) -> Column:
    """'2026-06-14' -> date; null if it is none."""
    return F.try_to_date(value, "yyyy-MM-dd")


def iso_timestamp(value: Column) -> Column:
    """'2026-07-09T10:00:00Z', with a fraction or an offset if given -> timestamp; null if it is none."""
    known = F.regexp_like(value, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)?$"))
    return F.when(known, F.try_to_timestamp(value))


def needs_ocr(source_type: Column, pages: Column) -> Column:
    """Whether a document's text has to come from OCR: an image, or a PDF none of whose pages has text."""
    blank = ~F.exists(F.coalesce(pages, F.array().cast("array<struct<page_number:int,text:string>>")), lambda p: F.trim(F.coalesce(p["text"], F.lit(""))) != "")
    return F.coalesce((source_type == "image") | ((source_type == "pdf") & blank), F.lit(False))


def clamp(x: Column) -> Column:
    """Into 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
