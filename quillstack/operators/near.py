"""Near-duplicate pages by SimHash, found by permuted blocks of its bits.

A text's SimHash has a bit set where more of its features' hashes have it set than not, so that
texts with nearly the same features differ in few bits. Two hashes that differ in `distance` bits at most agree in
BLOCKS - distance of their blocks at least; for each choice of so many blocks, hashes are
brought together by these, and compared bit by bit. Nothing within the distance is missed.

Equal hashes are one class. Large buckets are compared in cells of two parts of it, and cells send on
sums, not pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a feature, blocks of a hash beyond the distance, and hashes in a part of a bucket.
SHINGLE, SPARE, PART = 3, 2, 2048


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " ")


def features(text: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of the distinct runs of n lower-cased words; of all words, if there are fewer; none for a null or blank text."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    runs = lambda ws: F.when(F.size(ws) < n, F.when(F.size(ws) > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))).otherwise(F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda k: F.array_join(F.slice(ws, k, n), " ")))
    found = F.transform(F.array(words), lambda ws: F.transform(F.array_distinct(runs(ws)), lambda r: F.xxhash64(r)))[0]
    return F.coalesce(found, F.array().cast("array<bigint>"))


def simhashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, simhash (null without features)."""
    kind = docs.select(key, F.lit(None).cast("long").alias("simhash")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
            out = np.zeros(len(sizes), np.uint64)
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(sizes):
                own = values[ends[k] - sizes[k] : ends[k]]
                votes = np.zeros(64, np.int64)
                for at in range(0, len(own), 1 << 15):
                    votes += np.unpackbits(own[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                out[k] = np.packbits(2 * votes > sizes[k]).view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64), mask=sizes == 0)], names=[key, "simhash"])

    return docs.select(key, features(F.col(text)).alias("features")).mapInArrow(run, kind)


def blocks_of(distance: int) -> tuple[list[tuple[int, ...]], list[int]]:
    """(choices of blocks that must agree, each block's mask)."""
    n = distance + SPARE
    bounds = [64 * k // n for k in range(n + 1)]
    masks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in itertools.pairwise(bounds)]
    return list(itertools.combinations(range(n), n - distance)), masks


def _compare(rows: pa.Table, masks: np.ndarray, distance: int) -> dict:
    """simhash, n_links (documents of other classes), least (the smallest first id within the distance) in one cell; a pair counts in the first choice that brings it together."""
    value, first, n, own = rows["simhash"].to_numpy().view(np.uint64), rows["first"].to_numpy(), rows["n"].to_numpy(), rows["own"].to_numpy()
    choice, x, y = (rows[c][0].as_py() for c in ("choice", "x", "y"))
    links, least = np.zeros(len(value), np.int64), first.copy()
    left = np.flatnonzero(own == x)
    right = left if x == y else np.flatnonzero(own == y)
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        differs = value[some][:, None] ^ value[right]
        near = np.bitwise_count(differs) <= distance
        near &= differs != 0
        for earlier in masks[:choice]:
            near &= (differs & earlier) != 0
        links[some] += near @ n[right]
        least[some] = np.minimum(least[some], np.where(near, first[right], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if x != y:
            links[right] += near.T @ n[some]
            least[right] = np.minimum(least[right], np.where(near.T, first[some], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
    used = links > 0
    return {"simhash": value[used].view(np.int64), "n_links": links[used], "least": least[used]}


def near_duplicates(docs: DataFrame, key: str, text: str, distance: int = 3) -> DataFrame:
    """key, class_id (the smallest key with the same SimHash), n_copies (others with it), n_links (documents whose SimHash differs in 1 to `distance` bits), near_id (the smallest key among these and its own class).

    key: whole numbers. Null and blank texts have no SimHash: they are classes of their own without links.
    """
    hashed = simhashes(docs, key, text)
    classes = hashed.where("simhash is not null").groupBy("simhash").agg(F.min(key).cast("long").alias("first"), F.count("*").alias("n"))
    choices, masks = blocks_of(distance)
    whole = [sum(masks[b] for b in c) for c in choices]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = classes.select("*", F.posexplode(F.array(*(F.col("simhash").bitwiseAND(F.lit(signed(m))) for m in whole))).alias("choice", "block"))
    crowds = keyed.groupBy("choice", "block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("many")).where("many > 1").drop("many")
    dealt = keyed.join(crowds, ["choice", "block"]).withColumn("own", F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("choice", "block", "simhash", "first", "n", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    kind = "simhash long, n_links long, least long"
    table = np.array(whole, np.uint64)
    met = cells.groupBy("choice", "block", "x", "y").applyInArrow(lambda t: pa.table(_compare(t, table, distance)), kind)
    links = met.groupBy("simhash").agg(F.sum("n_links").alias("n_links"), F.min("least").alias("least"))
    judged = classes.join(links, "simhash", "left")
    found = hashed.join(judged, "simhash", "left")
    return found.select(
        key, F.coalesce("first", key).cast("long").alias("class_id"), F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.least("least", "first"), key).cast("long").alias("near_id"),
    )
