"""An index for approximate search: inverted lists of product-quantised vectors.

A vector is in the list of the centroid nearest to it, and what it differs from that
centroid by is kept as a code: the components are cut into parts, and each part is
the number of the nearest word in that part's code book, one byte. A query looks
through the lists of the centroids nearest to it by a table of its products with all words, so that a
code's score is a sum of as many table entries as there are parts. The best by code are scored exactly.

Centroids and code books are learned from a bounded sample; every vector is
in the index. Lists are cut into pieces of PIECE codes, so that a long list is
many tasks' work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import dot
from .retrieval import ranked

#: Vectors from which the index learns, at most about; words of a code book; parts of a code, a byte each.
SAMPLE, WORDS, PARTS = 20_000, 256, 8
#: Vectors of the sample that are asked for to see how many lists are needed.
TRIALS = 256
#: Of so many lists the nearest one is looked through first.
FIRST = 16
#: Codes in a piece of a list, and vectors to a centroid, about.
PIECE, LIST = 8192, 1000


@dataclass(frozen=True)
class Codec:
    """Centroids (lists x d) and words (parts x WORDS x width); vectors are padded to parts * width components."""

    centroids: np.ndarray
    words: np.ndarray
    probes: int = 1  # lists that a query has to look through

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.words.shape[0] * self.words.shape[2] - x.shape[1])))

    def lists(self, x: np.ndarray, many: int) -> np.ndarray:
        """The lists of each vector, the best first: least distance."""
        score = x @ self.centroids.T - 0.5 * np.einsum("ij,ij->i", self.centroids, self.centroids)
        many = min(many, score.shape[1])
        near = np.argpartition(-score, many - 1, axis=1)[:, :many]
        return np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = self.padded(x - self.centroids[own])
        width = self.words.shape[2]
        codes = np.empty((len(x), len(self.words)), np.uint8)
        for p, words in enumerate(self.words):
            part = rest[:, p * width : (p + 1) * width]
            codes[:, p] = (part @ words.T - 0.5 * np.einsum("ij,ij->i", words, words)).argmax(axis=1)
        return codes

    def table(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x WORDS: products of the queries' parts with all words."""
        return np.einsum("qpw,pkw->qpk", self.padded(q).reshape(len(q), *self.words.shape[::2]), self.words)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows; those that lose all rows start again at a row far from its own."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        score = x @ c.T - 0.5 * np.einsum("ij,ij->i", c, c)
        own = score.argmax(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(score[np.arange(len(x)), own])[: len(empty)]]
    return c


def learn(vectors: DataFrame, lists: int | None = None, parts: int = PARTS, recall: float = 0.97, seed: int = 1) -> Codec:
    """A codec from about SAMPLE vectors at most, dealt by the hash of vec_id; that sample is all that the driver holds.

    The index is of vectors of the commonest length.
    lists: by default one for LIST vectors, at most as many as a sixteenth of the sample. How many lists a
    query has to look through is measured: so many that TRIALS vectors of the sample
    find the share `recall` of their nearest ones in it. Vectors in clusters need a few lists, vectors without any need most of them.
    """
    sizes = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if sizes is None:
        return Codec(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    vectors, n = _usable(vectors, sizes["dim"]), sizes["n"]
    spread = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    rows = vectors.where(spread < min(1.0, SAMPLE / max(1, n))).orderBy("vec_id").select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float64)
    if not len(x):
        return Codec(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    rng = np.random.default_rng(seed)
    c = k_means(x, lists or max(1, min(round(n / LIST), len(x) // 16)), rng)
    width = -(-x.shape[1] // parts)
    plain = Codec(c, np.zeros((parts, 1, width)))
    rest = plain.padded(x - c[plain.lists(x, 1)[:, 0]])
    words = np.stack([k_means(rest[:, p * width : (p + 1) * width], min(WORDS, len(x)), rng) for p in range(parts)])
    codec = Codec(c, words)
    return replace(codec, probes=_probes(codec, x, recall, rng))


def _probes(codec: Codec, x: np.ndarray, recall: float, rng: np.random.Generator, near: int = 10) -> int:
    asked = rng.permutation(len(x))[:TRIALS]
    near = min(near, len(x) - 1)
    if near < 1:
        return len(codec.centroids)
    product = x[asked] @ x.T
    product[np.arange(len(asked)), asked] = -np.inf
    found = np.argpartition(-product, near - 1, axis=1)[:, :near]
    order = codec.lists(x[asked], len(codec.centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    ranks = np.take_along_axis(place, codec.lists(x, 1)[:, 0][found], 1)
    return int(np.sort(ranks.ravel())[math.ceil(recall * ranks.size) - 1]) + 1


def save(codec: Codec, index: DataFrame, path: str) -> None:
    """Keeps an index: its rows by list, so that a search reads only the lists it looks through, and the codec's numbers."""
    spark = index.sparkSession
    index.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/lists")
    rows = [("centroid", k, 0, v.tolist()) for k, v in enumerate(codec.centroids)] + [("word", p, k, v.tolist()) for p, part in enumerate(codec.words) for k, v in enumerate(part)] + [("probes", codec.probes, 0, [])]
    spark.createDataFrame(rows, "kind string, a int, b int, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/codec")


def load(spark: SparkSession, path: str) -> tuple[Codec, DataFrame]:
    """(codec, index) as saved; the codec has a bounded number of rows."""
    rows = sorted(spark.read.parquet(f"{path}/codec").collect(), key=lambda r: (r["kind"], r["a"], r["b"]))
    of = lambda kind: [r for r in rows if r["kind"] == kind]
    words = of("word")
    parts = 1 + max(r["a"] for r in words)
    codec = Codec(np.array([r["numbers"] for r in of("centroid")]), np.array([r["numbers"] for r in words]).reshape(parts, len(words) // parts, -1), of("probes")[0]["a"])
    return codec, spark.read.parquet(f"{path}/lists").select("vec_id", "cell", "code")


def _usable(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


def encoded(vectors: DataFrame, codec: Codec) -> DataFrame:
    """vec_id, cell, code: the index's rows, to be kept beside the vectors."""
    dim = codec.centroids.shape[1]
    kind = vectors.select("vec_id", F.lit(0).alias("cell"), F.lit(b"").alias("code")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dim)
            own = codec.lists(x, 1)[:, 0]
            codes = codec.encode(x, own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "cell", "code"])

    return _usable(vectors, dim).select("vec_id", "embedding").mapInArrow(run, kind)


def candidates(queries: DataFrame, index: DataFrame, codec: Codec, probes: int, keep: int) -> DataFrame:
    """query_id, vec_id, about: the `keep` best of each query by code, in the lists of its `probes` nearest centroids.

    Queries meet pieces of lists; a piece sends on `keep` rows for a query at most. The nearest lists, one in FIRST, are looked
    through before the others, which then send on only what is as good as the `keep` best there: what is sent for a query
    doesn't grow with the number of lists.
    """
    dim = codec.centroids.shape[1]
    placed = index.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)))
    pieces = placed.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))  # a row for each list
    asked_kind = queries.select("query_id", F.lit(0).alias("cell"), F.lit(0).alias("nth"), F.lit(b"").alias("q")).schema

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dim)
            cells = codec.lists(q, probes)
            at = pa.array(np.repeat(np.arange(len(q)), cells.shape[1]))
            nth = np.tile(np.arange(cells.shape[1], dtype=np.int32), len(q))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(cells.ravel().astype(np.int32)), pa.array(nth), pa.array([x.tobytes() for x in q], pa.binary()).take(at)], names=["query_id", "cell", "nth", "q"])

    asked = _usable(queries, dim).select("query_id", "embedding").mapInArrow(probe, asked_kind).join(F.broadcast(pieces), "cell")
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    lists = placed.join(F.broadcast(pieces), "cell").withColumn("piece", (F.col("piece") % F.col("pieces")).cast("int"))
    out = queries.crossJoin(index.limit(0)).select("query_id", "vec_id", F.lit(0.0).alias("about")).schema

    def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(rows) and len(asked):
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
            center = codec.centroids[rows["cell"][0].as_py()]
            step = max(1, (1 << 22) // len(rows))
            for at in range(0, len(asked), step):
                some = asked.slice(at, step)
                q = np.frombuffer(b"".join(some["q"].to_pylist()), np.float64).reshape(len(some), -1)
                table = codec.table(q)
                about = np.repeat((q @ center)[:, None], len(rows), axis=1)
                for p in range(codes.shape[1]):
                    about += table[:, p, codes[:, p]]
                best = np.argpartition(-about, keep - 1, axis=1)[:, :keep] if len(rows) > keep else np.broadcast_to(np.arange(len(rows)), about.shape)
                value = np.take_along_axis(about, best, 1)
                owner, place = np.nonzero(value >= some["floor"].to_numpy()[:, None])
                found.append(pa.table({"query_id": some["query_id"].take(pa.array(owner)), "vec_id": rows["vec_id"].take(pa.array(best[owner, place])), "about": value[owner, place]}))
        return pa.concat_tables(found) if found else pa.table({"query_id": asked["query_id"].slice(0, 0), "vec_id": rows["vec_id"].slice(0, 0), "about": pa.array([], pa.float64())})

    by = ("cell", "piece")
    codes_of = lists.select("cell", "piece", "vec_id", "code")
    order = W.partitionBy("query_id").orderBy(F.col("about").desc(), "vec_id")

    def best(questions: DataFrame) -> DataFrame:
        met = codes_of.groupBy(*by).cogroup(questions.select("cell", "piece", "query_id", "q", "floor").groupBy(*by)).applyInArrow(scan, out)
        return met.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= keep)

    lowest = F.lit(float("-inf"))
    nearest = best(asked.where(F.col("nth") < -(-probes // FIRST)).withColumn("floor", lowest))
    floors = nearest.where(F.col("__rank") == keep).select("query_id", F.col("about").alias("floor"))
    return best(asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", lowest))).drop("__rank")


def search(queries: DataFrame, vectors: DataFrame, index: DataFrame, codec: Codec, k: int, probes: int | None = None, keep: int = 160) -> DataFrame:
    """query_id, vec_id, score, rank of the k best of the `keep` candidates of each query by their exact dot products; ties go to the smaller id.

    queries: query_id, embedding; vectors: vec_id, embedding; index: what encoded()
    made of them, or of a part (only what is in the index is found; only what is in `vectors` is returned). probes: lists that a query looks through, by default
    as many as the codec found necessary. Vectors that are null, hold nulls or have another length are neither asked for nor found.
    """
    near = candidates(queries, index, codec, probes or codec.probes, max(keep, k))
    full = near.join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    scored = full.select("query_id", "vec_id", dot(F.col("q"), F.col("embedding")).alias("score"))
    return ranked(scored, k)
