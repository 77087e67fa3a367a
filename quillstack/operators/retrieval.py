"""Vector search with citations, and the context for an answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.answering import Answerer, answer, extract
#: Query vectors in one block, vectors in one block, and bytes of query vectors up to which all blocks are broadcast.
QUERY_BLOCK, BLOCK, BROADCAST_BYTES = 1000, 4096, 64 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length: their ids ascending, and the vectors in that order."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            some = batch.slice(at, BLOCK)
            some = some.take(pc.sort_indices(some.column(0)))
            sizes = pc.list_value_length(some.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                own = some.filter(pa.array(sizes == dim))
                flat = np.asarray(own.column(1).flatten(), np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([int(dim)], pa.int32()), pa.array([flat.tobytes()], pa.binary())], names=["ids", "dim", "vectors"])


def best_of(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of each query; ties go to the earlier row.

    A matrix product finds what may be among them, with room for its rounding; their
    scores are then summed from the first component on, as functions.text.dot does.
    """
    product = q @ x.T
    if len(x) > k:
        room = 4 * (q.shape[1] + 1) * 2.0**-53 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
        least = np.partition(product, len(x) - k, axis=1)[:, len(x) - k] - room
        query, row = np.nonzero(product >= least[:, None])
    else:
        query, row = (v.ravel() for v in np.indices(product.shape))
    score = np.zeros(len(query))
    for j in range(q.shape[1]):
        score += q[query, j] * x[row, j]
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    start = np.flatnonzero(np.diff(query, prepend=-1))
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[rank < k], row[rank < k], score[rank < k]


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank of the k nearest by dot product; ties go to the smaller id.

    queries: query_id, embedding; corpus: vec_id, embedding. Vectors are packed
    into blocks where they are read; each block of the corpus meets each block of queries, in one plan, and only
    its k best for each query leave the task. The queries' blocks are broadcast if their counted size allows it; else
    both sides' blocks are dealt to pairs of partitions. Vectors of another length, and
    those that are null or hold nulls or NaN, have no product. The work is queries times rows;
    vector_index is for query sets that grow with the corpus.
    """
    fine = lambda df, key: df.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).select(F.col(key), "embedding")
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    kinds = {key: df.schema[key].dataType.simpleString() for key, df in (("query_id", queries), ("vec_id", corpus))}
    blocks = -(-size["n"] // QUERY_BLOCK) or 1
    dealt = fine(queries, "query_id").repartition(blocks, F.xxhash64("query_id"))
    asked = dealt.mapInArrow(_packed, f"ids array<{kinds['query_id']}>, dim int, vectors binary").select(F.col("ids").alias("asking"), F.col("dim").alias("of"), F.col("vectors").alias("questions"))
    rows = fine(corpus, "vec_id").mapInArrow(_packed, f"ids array<{kinds['vec_id']}>, dim int, vectors binary")
    small = size["n"] * (size["dim"] or 0) * 8 <= BROADCAST_BYTES
    met = rows.crossJoin(F.broadcast(asked) if small else asked).where("dim = of").drop("of")
    out = f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(1)[i].as_py()
                x, q = (np.frombuffer(batch.column(c)[i].as_py(), np.float64).reshape(-1, dim) if dim else np.zeros((len(batch.column(j)[i]), 0)) for c, j in ((2, 0), (4, 3)))
                query, row, found = best_of(q, x, k)
                yield pa.RecordBatch.from_arrays([batch.column(3)[i].values.take(pa.array(query)), batch.column(0)[i].values.take(pa.array(row)), pa.array(found)], names=["query_id", "vec_id", "score"])

    return ranked(met.mapInArrow(score, out), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def citations(hits: DataFrame, pages: DataFrame, chars: int = 80) -> DataFrame:
    """Hits with the page that they cite and the start of its text.

    hits: query_id, rank, document_id, page_number; pages: document_id, page_number, text.
    A citation is of one page of a document, never of the document alone.
    """
    return hits.join(pages, ["document_id", "page_number"]).select("query_id", "rank", "document_id", "page_number", F.substring("text", 1, chars).alias("excerpt"))


def context(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """query_id, context: the hits' texts in rank order, a line break between. At most k texts meet in a group."""
    found = hits.join(pages, ["document_id", "page_number"])
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return found.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("context"))


def prompts(hits: DataFrame, pages: DataFrame, questions: DataFrame, chars: int = 1000, instruction: str = "Answer from the sources, and name them by their numbers.") -> DataFrame:
    """query_id, prompt: the instruction, the sources in rank order, numbered, each with its document and page and the start of its text, and the question.

    questions: query_id, text. At most k sources meet in a group; a hit whose page is not there is no source.
    """
    found = hits.join(pages, ["document_id", "page_number"]).select("query_id", F.struct("rank", "document_id", "page_number", F.substring("text", 1, chars).alias("text")).alias("source"))
    ordered = found.groupBy("query_id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    line = lambda x, k: F.concat(F.lit("["), k + 1, F.lit("] document "), x["document_id"], F.lit(", page "), x["page_number"], F.lit(": "), x["text"])
    asked = ordered.join(questions.select("query_id", "text"), "query_id")
    return asked.select("query_id", F.concat_ws("\n", F.lit(instruction), F.array_join(F.transform("sources", line), "\n"), F.concat(F.lit("Question: "), "text")).alias("prompt"))


def answers(hits: DataFrame, pages: DataFrame, questions: DataFrame | None = None, answerer: Callable[[], Answerer] | None = None) -> DataFrame:
    """query_id, answer, cited: what the answerer makes of the question and the hits' texts, with (document, page, score) of all hits.

    questions: query_id, text. Without an answerer the answer is an extract,
    the first sentences of the best hit.
    """
    found = hits.join(pages, ["document_id", "page_number"])
    cited = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id", "page_number", "score"))), lambda x: F.struct(x["document_id"], x["page_number"], x["score"]))
    if answerer is None:
        return found.groupBy("query_id").agg(extract(F.min_by("text", "rank")).alias("answer"), cited.alias("cited"))
    if questions is None:
        raise ValueError("an answerer needs the questions")
    asked = context(hits, pages).join(questions.select("query_id", "text"), "query_id")
    said = asked.select("query_id", answer(F.col("text"), F.col("context"), answerer).alias("answer"))
    return said.join(found.groupBy("query_id").agg(cited.alias("cited")), "query_id")
