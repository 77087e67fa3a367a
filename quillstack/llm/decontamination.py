"""Benchmark decontamination by greedy string tiling.

Seeds, runs of a few tokens that a document shares with a benchmark item, are
joined by running Karp-Rabin hashes. For each pair with enough seeds the
longest match of unmarked tokens is marked again and again, until none of the
seed's length is left; the share of the item's tokens that are marked is its
coverage, which does not depend on the passages' order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import wordhash as wh
from .common import pieces

#: Tokens: lower-cased runs of ASCII letters and digits and anything beyond ASCII.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Pairs of equal places up to which a tiling works on all pairs at once.
PAIRS = 1 << 22
#: Benchmark tokens up to which the seeds are broadcast (about 32 bytes each); beyond, they are joined by a shuffle.
BROADCAST_TOKENS = 1_000_000
PAIR = "doc_id long, item_id long, n_matched long, n_item long, coverage double, spans array<struct<first:long,after:long>>"


def hash_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    return wh.hash_words([(t or b"").translate(_TABLE) for t in texts])


def tile(doc: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, tokens) of two token sequences, the longest first.

    Ties go to the earliest place in the item, then in the document.
    """
    a, b = wh.runs(doc, seed), wh.runs(item, seed)
    if not len(a) or not len(b):
        return []
    order, _ = wh.groups(b)
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = high - low
    if n.sum() > PAIRS:
        return tile_lengths(doc, item, seed)
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(low, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
    return tile_hits(i, j, seed)


def tile_hits(i: np.ndarray, j: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The same from all pairs of places at which `seed` tokens agree."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    found = []
    while len(i):
        start = np.flatnonzero(np.concatenate([[True], (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1)]))
        size = np.diff(np.append(start, len(i)))
        best = min(np.flatnonzero(size == size.max()), key=lambda k: (j[start[k]], i[start[k]]))
        at, to, n = int(i[start[best]]), int(j[start[best]]), int(size[best]) + seed - 1
        found.append((at, to, n))
        free = ((i + seed <= at) | (i >= at + n)) & ((j + seed <= to) | (j >= to + n))
        i, j = i[free], j[free]
    return found


def tile_lengths(doc: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The same where places agree so often that their pairs don't fit: by the longest length at which any free runs agree.

    Memory is linear in the texts. A length is found by halving, as runs that
    agree in n tokens agree in fewer.
    """
    free_a, free_b = np.ones(len(doc), bool), np.ones(len(item), bool)

    def places(words: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of n free tokens, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[n:] == taken[: len(taken) - n])
        return at, wh.runs(words, n)[at]

    found, most = [], min(len(doc), len(item))
    while most >= seed:
        low, high = seed - 1, most
        while low < high:
            n = (low + high + 1) // 2
            (_, x), (_, y) = places(doc, free_a, n), places(item, free_b, n)
            low, high = (n, high) if len(np.intersect1d(x, y)) else (low, n - 1)
        if low < seed:
            break
        most = low
        (at, x), (to, y) = places(doc, free_a, low), places(item, free_b, low)
        j = to[np.isin(y, x)][0]
        i = at[x == y[np.searchsorted(to, j)]][0]
        found.append((int(i), int(j), low))
        free_a[i : i + low] = free_b[j : j + low] = False
    return found


def _verdict(doc_id: int | None, item_id: int | None, tiles: list[tuple[int, int, int]], size: int) -> tuple:
    spans = [{"first": a, "after": a + n} for a, _, n in sorted(tiles)]
    matched = sum(n for _, _, n in tiles)
    return doc_id, item_id, matched, size, matched / size, spans


class Seeds:
    """All seeds of a benchmark: sorted hashes, and the item and place of each."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], seed: int):
        words, offsets = hash_tokens(texts)
        doc = wh.owners(offsets)
        fits = np.flatnonzero(offsets[doc + 1] - np.arange(len(doc)) >= seed) if len(doc) else np.zeros(0, np.int64)
        hashes = wh.runs(words, seed)[fits] if len(fits) else np.zeros(0, np.uint64)
        order, first = wh.groups(hashes)
        self.ids, self.sizes, self.seed, self.tokens, self.offsets = ids, np.diff(offsets), seed, words, offsets
        self.kinds, self.first = hashes[order][first] if len(first) else hashes, np.append(first, len(order))
        self.item, self.place = doc[fits][order], (fits - offsets[doc[fits]])[order]

    def found(self, words: np.ndarray, threshold: float) -> Iterator[tuple[int, list]]:
        """(item's index, tiles) of the items that one document's tokens cover enough."""
        hashes = wh.runs(words, self.seed)
        hit, kind = wh.members(hashes, self.kinds)
        at, kind = np.flatnonzero(hit), kind[hit]
        n = self.first[kind + 1] - self.first[kind]
        if n.sum() > PAIRS:
            yield from self._found_by_item(words, np.unique(kind), threshold)
            return
        i = np.repeat(at, n)
        where = np.repeat(self.first[kind], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        item, j = self.item[where], self.place[where]
        order, start = wh.groups(item)
        for k, s in enumerate(start):
            own = order[s : start[k + 1] if k + 1 < len(start) else len(order)]
            x, places = int(item[own[0]]), np.unique(j[own])
            # tokens that any tiling could mark at most
            most = np.minimum(np.diff(places), self.seed).sum() + self.seed
            if most >= threshold * self.sizes[x]:
                tiles = tile_hits(i[own], j[own], self.seed)
                if sum(t[2] for t in tiles) >= threshold * self.sizes[x]:
                    yield x, tiles


    def _found_by_item(self, words: np.ndarray, kinds: np.ndarray, threshold: float) -> Iterator[tuple[int, list]]:
        """The same one item at a time, where all at once would be too many pairs of places."""
        where = np.concatenate([np.arange(self.first[k], self.first[k + 1]) for k in kinds])
        for x in np.unique(self.item[where]).tolist():
            tiles = tile(words, self.tokens[self.offsets[x] : self.offsets[x + 1]], self.seed)
            if sum(t[2] for t in tiles) >= threshold * self.sizes[x]:
                yield x, tiles


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """Pairs of a document and a benchmark item of which it covers `threshold` at least.

    doc_id, item_id, n_matched, n_item (tokens), coverage and the marked spans
    of the document's tokens. `seed` is the tiling's least match: items of fewer
    tokens have no tile and are never covered; null and empty texts cover nothing. Repeated rows of documents or
    items give a pair each, and so do rows whose id is null, which stays null. Columns other than ids and texts are not read.
    Benchmarks beyond `broadcast_tokens` tokens meet the documents in a join instead; the pairs are the same.
    """
    from .chunks import arrow_schema

    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("text"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = arrow_schema(docs, PAIR)
    # a token takes two bytes at least, so the bytes bound the tokens
    bound = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    if bound > broadcast_tokens:
        return _by_shuffle(rows, items, threshold, seed, schema)
    known = sorted(((r["item_id"], bytes(r["text"])) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    seeds = docs.sparkSession.sparkContext.broadcast(Seeds([k for k, _ in known], [t for _, t in known], seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = seeds.value
        for batch in batches:
            for part in pieces(batch, 1):
                words, offsets = hash_tokens(part.column(1).to_pylist())
                hit, _ = wh.members(wh.runs(words, s.seed), s.kinds)
                near = np.unique(wh.owners(offsets)[np.flatnonzero(hit)])  # few documents have a seed at all
                ids, out = part.column(0).to_pylist(), []
                for k in near:
                    for x, tiles in s.found(words[offsets[k] : offsets[k + 1]], threshold):
                        out.append(_verdict(ids[k], s.ids[x], tiles, int(s.sizes[x])))
                yield _batches(out, schema)

    return rows.mapInArrow(run, PAIR)


def _by_shuffle(rows: DataFrame, items: DataFrame, threshold: float, seed: int, schema: pa.Schema) -> DataFrame:
    """For benchmarks beyond the bound: seeds meet in a join, then the texts of the pairs that can be covered.

    Rows are known by a hash of id and text in between, so that null ids and
    repeated rows keep their pairs. A tile of n tokens has n - seed + 1 seeds, so
    a covered item shares threshold * n / seed of its n - seed + 1 seed places at
    least; it is enough to look for a document at the rarest places, all but
    those that may be missing. A seed common to the whole corpus is looked for only by items
    that have hardly another.
    """
    rows = rows.withColumn("doc", F.xxhash64("id", "text"))
    items = items.withColumn("item", F.xxhash64("item_id", "text"))

    def seeds(df: DataFrame, key: str) -> DataFrame:
        """Each row's distinct seeds, the places that have them, and all its places."""
        arrow = "key long, seeds array<long>, places array<int>, size int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, 1):
                    words, offsets = hash_tokens(part.column(1).to_pylist())
                    found = [np.unique(wh.runs(words[a:b], seed).astype(np.int64), return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    columns = (pa.array([x.tolist() for x, _ in found], pa.list_(pa.int64())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int32())), pa.array(np.diff(offsets), pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["key", "seeds", "places", "size"])

        return df.select(key, "text").mapInArrow(run, arrow).select(F.col("key").alias(key), "size", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(key, "size", F.col("s.seeds").alias("seed"), F.col("s.places").alias("places"))

    theirs = seeds(items.dropDuplicates(["item"]), "item").where(F.col("size") >= seed)
    ours = seeds(rows, "doc").select("doc", "seed").distinct().join(theirs.select("seed").distinct(), "seed", "left_semi")
    often = ours.groupBy("seed").agg(F.count("*").alias("often"))
    # rarest first; `before` places have been asked for already
    order = W.partitionBy("item").orderBy("often", "seed").rowsBetween(W.unboundedPreceding, -1)
    needed = F.greatest(F.lit(1), F.ceil(threshold * F.col("size") / seed - 1e-9))
    ranked = theirs.join(often, "seed", "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("before", F.coalesce(F.sum("places").over(order), F.lit(0)))
    asked = ranked.where((F.col("before") <= F.col("size") - seed + 1 - needed) & (F.col("often") > 0)).select("item", "seed")
    pairs = ours.join(asked, "seed").select("doc", "item").distinct()
    both = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(rows, "doc").select("id", "item_id", "text", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                out = []
                for i, x, text, item in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                    a, b = hash_tokens([text])[0], hash_tokens([item])[0]
                    tiles = tile(a, b, seed)
                    if tiles and sum(t[2] for t in tiles) >= threshold * len(b):
                        out.append(_verdict(i, x, tiles, len(b)))
                yield _batches(out, schema)

    return both.mapInArrow(run, PAIR)
