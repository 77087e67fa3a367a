"""The two entry points: take files in, and answer questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.answering import Answerer
from .functions.embedding import Encoder, embed, hashing_encoder
from .operators import guard, retrieval, vector_index
from .operators.vector_index import Codec
from .sources import ingest as source
from .sources.parsers import Parser


def ingest(spark: SparkSession, path: str, uploaded_by: str, folder: str, parsers: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejected files with their reason) of all files under a path, and of the files in its containers."""
    uploads = source.unpack(source.files(spark, path)).withColumns({"uploaded_by": F.lit(uploaded_by), "folder": F.lit(folder)})
    checked = source.validate(uploads)
    parsed = source.parse(checked.where("reason is null"), parsers)
    refused = checked.where("reason is not null").select("storage_path", "reason")
    return source.normalize(parsed), refused.union(parsed.where("error is not null").select("storage_path", "error"))


def ask(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, docs: DataFrame, effective: DataFrame, user_id: str, k: int = 5, answerer: Callable[[], Answerer] | None = None, encoder: Callable[[], Encoder] = hashing_encoder, index: tuple[Codec, DataFrame] | None = None) -> DataFrame:
    """query_id, answer, cited. questions: query_id, text.

    vectors: document_id, page_number, chunk_index, embedding, as sinks.rebuild_vectors has
    stored them; only the questions are embedded here, by the encoder that made them. chunks: document_id,
    page_number, chunk_index, chunk; only those of the hits are fetched. With index (vector_index.learn, encoded over
    vector_keys) the search looks through its lists instead of all vectors.

    Only chunks of documents that the user may see are ranked; effective is
    the user's folders (guard.effective_folders). The answerer is that of retrieval.answers.
    """
    seen = guard.visible_or_owned(guard.not_deleted(docs), effective, F.lit(user_id)).select(F.col("id").alias("document_id"))
    allowed = vector_keys(vectors.join(seen, "document_id", "left_semi"))
    asked = questions.select("query_id", embed(F.col("text"), encoder).alias("embedding"))
    if index is None:
        found = retrieval.top_k(asked, allowed.select("vec_id", "embedding"), k)
    else:
        codec, rows = index
        found = vector_index.search(asked, allowed, rows.join(allowed.select("vec_id"), "vec_id", "left_semi"), codec, k)
    # a chunk's key takes its document's place until the citation is made: several chunks of a page may be hits
    place = ["document_id", "page_number", "chunk_index"]
    hits = found.join(allowed.select("vec_id", *place), "vec_id")
    texts = hits.select("vec_id", *place).distinct().join(chunks.select(*place, "chunk"), place).select(F.col("vec_id").alias("document_id"), "page_number", F.col("chunk").alias("text"))
    hits = hits.select("query_id", "rank", "score", F.col("vec_id").alias("document_id"), "page_number")
    answered = retrieval.answers(hits, texts, questions, answerer)
    document = lambda x: F.regexp_extract(x["document_id"], r"^(.*)/[^/]*/[^/]*$", 1).alias("document_id")
    return answered.withColumn("cited", F.transform("cited", lambda x: F.struct(document(x), x["page_number"].alias("page_number"), x["score"].alias("score"))))


def vector_keys(vectors: DataFrame) -> DataFrame:
    """Stored vectors with vec_id, the key that their pointer rows name."""
    return vectors.withColumn("vec_id", F.concat_ws("/", "document_id", "page_number", "chunk_index"))
