"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

toxicity -> near duplicates -> repeated passages -> benchmark passages -> mix.
Each stage works on all that its predecessor kept. The first four return the
columns of documents; the last returns the mix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import common, decontamination, mixing, ngram_join, substring_dedup, toxicity


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns under private names, which no operator's results clash with, and the way back."""
    names = {c: f"__doc_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    return docs.withColumnsRenamed(names), {new: c for c, new in names.items()}


def _without(docs: DataFrame, row: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """docs without the rows named in `gone` (its column `row`)."""
    return docs.join(gone.select(row).distinct(), row, "left_anti").select(*columns)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; learns from the labels outside fold 0."""
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(common.fold_of("doc_id", 5) != 0))
    plain, back = _apart(docs)
    return toxicity.toxicity(plain, model, keep=tuple(plain.columns)).where("predicted = 0").select(*plain.columns).withColumnsRenamed(back).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; of rows that share an id, one."""
    rows, row = common.numbered(docs)
    groups = ngram_join.ngram_join(rows, id_col=row).groups
    return _without(rows, row, groups.where("doc_id <> group_id").select(F.col("doc_id").alias(row)), docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that a document with a smaller id has; other texts stay as they are."""
    plain, back = _apart(docs)
    found = substring_dedup.substring_dedup(plain.withColumn("__doc_text", F.col("text")), carry=("__doc_text", *(c for c in plain.columns if c not in ("doc_id", "text"))))
    shorter = F.col("n_removed") > 0
    new = {"__doc_text": F.when(shorter, F.col("kept")).otherwise(F.col("__doc_text"))}
    for private, c in back.items():
        if c == "n_chars":
            new[private] = F.when(shorter, F.length("kept").cast("long")).otherwise(F.col(private))
    return found.withColumns(new).select("doc_id", F.col("__doc_text").alias("text"), *(c for c in plain.columns if c not in ("doc_id", "text"))).withColumnsRenamed(back).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover half of a benchmark item or more."""
    rows, row = common.numbered(docs)
    found = decontamination.decontaminate(rows, common.table(spark, sf_dir, "benchmark"), id_col=row)
    return _without(rows, row, found.select(F.col("doc_id").alias(row)), docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes what is left to target weights: one row a document with the words that the mix takes."""
    return mixing.mix(docs).docs


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("mixing", source_mix),
]

#: The stages learn, hash and tile; SQL can't express them, so tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    What a stage keeps is written to the shared folder that spark.checkpoint.dir
    names, and deleted when the next one's result has been written; only the last stage's input stays.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            common.remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
