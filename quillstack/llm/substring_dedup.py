"""Substring dedup by fixed-block anchors.

1. Every document's non-overlapping blocks of half a window are indexed and
   probed with every rolling window of that length in the corpus: a hit is a
   block that another place shares. A repeat of a whole window holds at least
   one whole block of the copy it repeats, so none is missed.
2. Hits are extended: every full window that holds a hit is compared, by a
   128-bit hash, with those of all other documents.
3. Windows that also start in a document with a smaller id are marked; runs of
   marked words are the maximal exact repeats.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .chunks import Chunks, answer, ids_of, slices, unpack


def _places(offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from which k words of one document stand, in documents of a window at least; and their documents."""
    doc = wh.owners(offsets)
    at = np.arange(len(doc))
    fits = (offsets[doc + 1] - at >= k) & (offsets[doc + 1] - offsets[doc] >= window)
    return at[fits], doc[fits]


def _blocks(rows: pa.Table, block: int, window: int, bits: int):
    words, offsets = wh.hash_words(rows["text"].to_pylist())
    at, doc = _places(offsets, block, window)
    # the highest bits name the bucket, the next 32 the value in it; extension corrects chance hits
    short = wh.runs(words, block)[at] >> np.uint64(32 - bits) if len(at) else np.zeros(0, np.uint64)
    return words, offsets, at, doc, short


def index_and_probe(chunks: Chunks, window: int) -> DataFrame:
    """chunk, bucket, values: the runs of half a window, in each chunk, that are a block of some document and stand elsewhere too."""
    block, bits = window // 2, chunks.bits

    def tell(rows: pa.Table) -> dict:
        _, offsets, at, doc, short = _blocks(rows, block, window, bits)
        order, first = wh.groups(short)
        kinds = short[order][first] if len(first) else short
        aligned = (at - offsets[doc]) % block == 0
        indexed = np.logical_or.reduceat(aligned[order], first) if len(first) else np.zeros(0, bool)
        last = np.append(first[1:], len(order)) - 1
        many = doc[order][first] != doc[order][last] if len(first) else np.zeros(0, bool)
        bounds = slices((kinds >> np.uint64(32)).astype(np.int64), 1 << bits)
        used = np.flatnonzero(np.diff(bounds))
        cut = [slice(bounds[b], bounds[b + 1]) for b in used]
        low = kinds.astype(np.uint32)
        return {
            "bucket": used.astype(np.int32), "chunk": np.full(len(used), rows["chunk"][0].as_py(), np.int32),
            "values": [low[s].tobytes() for s in cut],
            "indexed": [np.packbits(indexed[s]).tobytes() for s in cut], "many": [np.packbits(many[s]).tobytes() for s in cut],
        }

    def match(rows: pa.Table) -> dict:
        values, row = unpack(rows["values"], np.uint32)
        sizes = np.bincount(row, minlength=len(rows))
        flags = [np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows[c].to_pylist(), sizes, strict=True)]).astype(bool) for c in ("indexed", "many")]
        order, first = wh.groups(values)
        n = np.diff(np.append(first, len(order)))
        shared = np.logical_or.reduceat(flags[0][order], first) & ((n > 1) | np.logical_or.reduceat(flags[1][order], first))
        hit = np.zeros(len(values), bool)
        hit[order] = np.repeat(shared, n)
        values, row = values[hit], row[hit]
        bounds = slices(row, len(rows))
        used = np.flatnonzero(np.diff(bounds))
        return {
            "chunk": rows["chunk"].to_numpy()[used], "bucket": rows["bucket"].to_numpy()[used],
            "values": [values[bounds[r] : bounds[r + 1]].tobytes() for r in used],
        }

    told = chunks.tell(tell, "bucket int, chunk int, values binary, indexed binary, many binary")
    return answer(told, match, "chunk int, bucket int, values binary")


def extend(chunks: Chunks, hits: DataFrame, window: int) -> DataFrame:
    """chunk, windows, first_id: windows around hits that start in several documents, and the smallest id among these."""
    block, bits = window // 2, chunks.bits

    def tell(rows: pa.Table, got: pa.Table) -> dict:
        empty = {"bucket": [], "chunk": [], "one": [], "two": [], "ids": [], "many": []}
        if not len(rows) or not len(got):
            return empty
        words, offsets, at, doc, short = _blocks(rows, block, window, bits)
        low, row = unpack(got["values"], np.uint32)
        pool = np.sort((got["bucket"].to_numpy().astype(np.uint64)[row] << np.uint64(32)) | low)
        hit, _ = wh.members(short, pool)
        at, doc = at[hit], doc[hit]
        # every window start from which the hit lies inside
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, np.maximum(at - (window - block), offsets[doc]), 1)
        np.add.at(edge, at + 1, -1)
        around = np.cumsum(edge[:-1]) > 0
        at, doc = _places(offsets, window, window)
        at, doc = at[around[at]], doc[around[at]]
        if not len(at):
            return empty
        one, two = wh.runs(words, window)[at], wh.runs(words, window, wh.SECOND)[at] >> np.uint64(32)
        ids = ids_of(rows)[doc]
        order, first = wh.groups(one)
        low_id, high_id = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        one, two = one[order][first], two[order][first].astype(np.uint32)
        bounds = slices((one >> np.uint64(64 - bits)).astype(np.int64), 1 << bits)
        used = np.flatnonzero(np.diff(bounds))
        cut = [slice(bounds[b], bounds[b + 1]) for b in used]
        return {
            "bucket": used.astype(np.int32), "chunk": np.full(len(used), rows["chunk"][0].as_py(), np.int32),
            "one": [one[s].tobytes() for s in cut], "two": [two[s].tobytes() for s in cut], "ids": [low_id[s].tobytes() for s in cut],
            "many": [np.packbits(low_id[s] != high_id[s]).tobytes() for s in cut],
        }

    def match(rows: pa.Table) -> dict:
        one, row = unpack(rows["one"], np.uint64)
        two, ids = unpack(rows["two"], np.uint32)[0], unpack(rows["ids"], np.int64)[0]
        sizes = np.bincount(row, minlength=len(rows))
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["many"].to_pylist(), sizes, strict=True)]).astype(bool)
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        first = np.flatnonzero(new)
        least = np.empty(len(one), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(order))))
        told = (least < ids) | many
        one, least, row = one[told], least[told], row[told]
        bounds = slices(row, len(rows))
        used = np.flatnonzero(np.diff(bounds))
        return {
            "chunk": rows["chunk"].to_numpy()[used],
            "windows": [one[bounds[r] : bounds[r + 1]].tobytes() for r in used],
            "first_id": [least[bounds[r] : bounds[r + 1]].tobytes() for r in used],
        }

    told = chunks.tell(tell, "bucket int, chunk int, one binary, two binary, ids binary, many binary", hits)
    return answer(told, match, "chunk int, windows binary, first_id binary")


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes what repeats, in exact runs of `window` words at least, a document with a smaller id.

    One row a document: its id, n_words, n_removed, spans (first word and word
    after the last of each maximal repeat), kept (the words that stay, one
    space between) and the carried columns under their own names. Words are
    runs of anything but ASCII white space, unchanged. Null and empty texts
    have no words and an empty `kept`; documents of fewer than `window` words
    keep all. Rows that share an id do not count as copies of each other; of
    equal texts the one with the smallest id stays whole. Null ids come after
    all others and count as one id. Columns that are not carried are not read.
    """
    chunks = Chunks(docs, id_col, text_col, carry)
    answers = extend(chunks, index_and_probe(chunks, window), window)
    kinds = dict(docs.select(*carry).dtypes) if carry else {}
    schema = "id long, n_words long, n_removed long, spans array<struct<first:long,after:long>>, kept binary" + "".join(f", c{i} {kinds[c]}" for i, c in enumerate(carry))

    def mark(rows: pa.Table, got: pa.Table) -> dict:
        texts = rows["text"].to_pylist()
        words, offsets = wh.hash_words(texts)
        gone = np.zeros(len(words), bool)
        if len(got):
            told, _ = unpack(got["windows"], np.uint64)
            order = np.argsort(told)
            told, first_id = told[order], unpack(got["first_id"], np.int64)[0][order]
            at, doc = _places(offsets, window, window)
            hit, where = wh.members(wh.runs(words, window)[at], told)
            at, doc, where = at[hit], doc[hit], where[hit]
            at = at[first_id[where] < ids_of(rows)[doc]]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
        kept, spans, removed = [], [], []
        for k, text in enumerate(texts):
            own = gone[offsets[k] : offsets[k + 1]]
            split = (text or b"").split()
            if own.any():
                turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans.append([{"first": int(a), "after": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
                split = compress(split, (~own).tolist())
            else:
                spans.append([])
            removed.append(int(own.sum()))
            kept.append(b" ".join(split))
        out = {"id": rows["id"], "n_words": np.diff(offsets), "n_removed": removed, "spans": spans, "kept": kept}
        return out | {f"c{i}": rows[f"c{i}"] for i in range(len(carry))}

    found = chunks.tell(mark, schema, answers)
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", "spans", F.col("kept").cast("string").alias("kept"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))
