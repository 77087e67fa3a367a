"""N-gram Jaccard join by MinHash banding.

1. A document's set of word 5-grams gives a MinHash signature; documents with
   equal sets form a copy class, and only its smallest id goes on.
2. Bands of the signature are shuffled on their hashes; number of bands and
   rows follow from the threshold and the recall asked for.
3. Within a band's bucket every document is paired with the bucket's leader
   (its smallest id), and the pair is verified on the full sets; documents that
   match are settled. So a bucket of near copies is not expanded into all its
   pairs.
4. Documents that do not match their bucket's leader are compared with each
   other and with the settled ones, in blocks: sketches first, then the full
   sets of those that sketches leave. If a document's likeness to the leader is
   under 2 t - 1, the triangle inequality of the Jaccard distance rules out a
   link to what the leader settled, and only the unsettled are looked at. No
   pair is taken twice: it belongs to the first band that both share.
5. These links make groups by label propagation with pointer jumping. They
   connect all that belongs together, but leave out pairs of settled documents.
6. Every linked pair lies within a group, so all pairs of a group that still
   lacks some are looked at in blocks, whether they share a band or not: sizes,
   then sketches, then the full sets. The blocks add up each document's links;
   pairs become rows only for who reads `links`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .chunks import arrow_schema, squeeze, stretch
from .common import cut, lookup, numbered, pieces

#: Documents in a block of such a comparison.
BLOCK = 512
#: Shingles in a block of full sets, and shingles compared at a time.
VOLUME, WIDTH = 1 << 21, 1 << 15


@dataclass
class Join:
    members: DataFrame  # doc_id, class_id: the smallest id with an equal set; documents without words are their own
    links: DataFrame  # a, b, jaccard: all linked pairs of class representatives, made when read
    groups: DataFrame  # doc_id, class_id, group_id, n_links


def bands_for(threshold: float, recall: float, hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which at most `hashes` reach the recall at the threshold."""
    best = None
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def shingle_sets(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, text after text, ascending within each; and offsets. Fewer than n words make one shingle."""
    words, offsets = wh.hash_words(texts)
    runs = wh.runs(words, n)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(wh.mix(wh.runs(words[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def signatures(sets: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """MinHash values (uint32), a row for each set; sets must not be empty."""
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, count, dtype=np.uint32)
    out = np.empty((len(offsets) - 1, count), np.uint32)
    h = (sets >> np.uint64(32)).astype(np.uint32)
    low = sets.astype(np.uint32)
    for k in range(count):
        x = (h ^ (low * add[k])) * odd[k]
        x ^= x >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), offsets[:-1])
    return out


def _profiles(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128 bits of the set), bands, sketch (a byte of each MinHash value)."""
    schema = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"
    arrow = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                sets, offsets = shingle_sets(part.column(1).to_pylist(), n)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                sums = []
                for salt in (0, 0x51ED270B):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(wh.mix(sets + np.uint64(salt)))])
                    sums.append((total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64))
                keys: list = [None] * len(sizes)
                sketch: list = [b""] * len(sizes)
                if len(full):
                    low = signatures(sets, np.append(offsets[:-1][full], len(sets)), bands * rows)
                    base = np.uint64(wh.FIRST)
                    for k, own in zip(full, low, strict=True):
                        sketch[k] = own.astype(np.uint8).tobytes()
                    cells = low.astype(np.uint64).reshape(len(full), bands, rows)
                    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(full), bands))
                    for r in range(rows):
                        key = wh.mix(key * base + cells[:, :, r])
                    for k, own in zip(full, key.astype(np.int64).tolist(), strict=True):
                        keys[k] = own
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array(keys, arrow.field(4).type), pa.array(sketch, pa.binary())], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def pack(shingles: np.ndarray) -> bytes:
    """An ascending set, each hash by its first 40 bits; two sets of a thousand confuse a shingle once in a million pairs."""
    return squeeze(shingles >> np.uint64(24), ascending=True)


def _sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, shingles: the full set, packed."""
    arrow = arrow_schema(docs, "doc_id long, shingles binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                sets, offsets = shingle_sets(part.column(1).to_pylist(), n)
                packed = [pack(sets[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    """Of two packed ascending sets."""
    x, y = stretch(a, np.uint64, ascending=True), stretch(b, np.uint64, ascending=True)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    hit, _ = wh.members(x, y)
    both = int(hit.sum())
    return both / (len(x) + len(y) - both)


def _verify(pairs: DataFrame, profiles: DataFrame, sets: DataFrame, floor: float, slack: float) -> DataFrame:
    """a, b, jaccard of distinct pairs whose Jaccard is `floor` at least.

    Sizes rule out pairs first, then sketches that agree in less than
    floor - slack of their places (slack is four standard errors or more).
    """
    side = profiles.select("doc_id", "n_shingles", "sketch")

    def with_side(df: DataFrame, source: DataFrame, key: str, *columns: str) -> DataFrame:
        return df.join(source.select(F.col("doc_id").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in columns)), key)

    near = with_side(with_side(pairs, side, "a", "n_shingles", "sketch"), side, "b", "n_shingles", "sketch")
    near = near.where(F.least("a_n_shingles", "b_n_shingles") >= floor * F.greatest("a_n_shingles", "b_n_shingles"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.stack([np.frombuffer(v, np.uint8) for v in batch.column(k).to_pylist()]) for k in (2, 3))
                batch = batch.filter(pa.array((x == y).mean(axis=1) >= floor - slack))
            yield batch.select([0, 1])

    near = near.select("a", "b", "a_sketch", "b_sketch").mapInArrow(alike, "a long, b long")
    full = with_side(with_side(near, sets, "a", "shingles"), sets, "b", "shingles").select("a", "b", "a_shingles", "b_shingles")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                values = [jaccard(a, b) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, pa.float64())], names=["a", "b", "jaccard"])

    return full.mapInArrow(exact, "a long, b long, jaccard double").where(F.col("jaccard") >= floor)


def components(links: DataFrame) -> DataFrame:
    """doc_id, group_id (the smallest id connected) of every document with a link.

    Each round takes the least label of the neighbours; every other round then
    jumps to that label's own. Labels are written each round, so lineage stays
    short. The edges of a document with very many are not brought together: labels
    join them, which Spark splits where a key is hot, and minima are taken before the shuffle.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(edges.distinct())
    labels = cut(edges.groupBy(F.col("b").alias("doc_id")).agg(F.least(F.min("a"), F.min("b")).alias("group_id")))
    turn = 0
    while True:
        near = edges.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("group_id").alias("near"))
        new = labels.join(near, "doc_id").select("doc_id", F.least("group_id", "near").alias("new_id"), "group_id")
        if turn % 2:
            up = labels.select(F.col("doc_id").alias("new_id"), F.col("group_id").alias("up"))
            new = new.join(up, "new_id").select("doc_id", F.least("new_id", "up").alias("new_id"), "group_id")
        new = cut(new)
        changed = not new.where("new_id <> group_id").isEmpty()
        labels = new.select("doc_id", F.col("new_id").alias("group_id"))
        turn += 1
        if not changed:
            return labels


def _unsettled(buckets: DataFrame, picked: DataFrame, sets: DataFrame, threshold: float, slack: float) -> DataFrame:
    """a, b, jaccard: the links of documents that their buckets' leaders have not settled.

    buckets: key, band, id, state (0: unsettled, 1: unsettled and near the
    leader, 2: settled, the leader itself included). A bucket's documents are dealt
    to blocks; each pair of blocks is a group of 2 * BLOCK documents about.
    """
    open_ = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("state").alias("least")).where("least < 2").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cells = buckets.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "band", "state", "id")
    cells = cells.join(picked.select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sketch"), "id")
    kind = "key long, x int, y int, ids binary, pairs binary"
    arrow = arrow_schema(buckets, kind)

    def near(rows: pa.Table) -> pa.Table:
        """The group's pairs that sketches leave, packed: positions in the ids of the documents concerned."""
        rows = rows.sort_by("id")
        ids, own, state, size = (rows[c].to_numpy() for c in ("id", "own", "state", "n_shingles"))
        sketch = np.stack([np.frombuffer(v, np.uint8) for v in rows["sketch"].to_pylist()])
        bands = np.stack(rows["bands"].to_pylist())
        band = rows["band"][0].as_py()
        mixed = len(np.unique(own)) > 1
        out = [np.zeros((0, 2), np.int32)]
        for k in range(len(ids) - 1):
            at = np.arange(k + 1, len(ids))
            other = state[at]
            # a settled document meets those near the leader; of the others, only these meet settled ones
            hit = other == 1 if state[k] == 2 else (other < 2) | (state[k] == 1)
            if mixed:
                hit &= own[at] != own[k]
            hit &= np.minimum(size[at], size[k]) >= threshold * np.maximum(size[at], size[k])
            at = at[hit]
            at = at[(sketch[at] == sketch[k]).mean(axis=1) >= threshold - slack] if len(at) else at
            if len(at):
                at = at[(bands[at] == bands[k]).argmax(axis=1) == band]
                out.append(np.column_stack([np.full(len(at), k), at]).astype(np.int32))
        pairs = np.concatenate(out)
        if not len(pairs):
            return arrow.empty_table()
        used, place = np.unique(pairs, return_inverse=True)
        return pa.table({"key": rows["key"][:1], "x": rows["x"][:1], "y": rows["y"][:1], "ids": [ids[used].tobytes()], "pairs": [place.reshape(-1, 2).astype(np.int32).tobytes()]}, schema=arrow)

    packed = cut(cells.groupBy("key", "x", "y").applyInArrow(near, kind))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x, y, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key)), pa.array(np.full(len(own), x, np.int32)), pa.array(np.full(len(own), y, np.int32)), pa.array(own)], names=["key", "x", "y", "doc_id"])

    wanted = packed.select("key", "x", "y", "ids").mapInArrow(documents, "key long, x int, y int, doc_id long").join(sets, "doc_id")
    link = arrow_schema(buckets, "a long, b long, jaccard double")

    def exact(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(pairs):
            return link.empty_table()
        ids = np.frombuffer(pairs["ids"][0].as_py(), np.int64)
        own = dict(zip(rows["doc_id"].to_pylist(), rows["shingles"].to_pylist(), strict=True))
        found = []
        for i, j in np.frombuffer(pairs["pairs"][0].as_py(), np.int32).reshape(-1, 2).tolist():
            a, b = int(ids[i]), int(ids[j])
            value = jaccard(own[a], own[b])
            if value >= threshold:
                found.append((a, b, value))
        return pa.table({n: [f[k] for f in found] for k, n in enumerate(("a", "b", "jaccard"))}, schema=link)

    by = ("key", "x", "y")
    return packed.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(exact, "a long, b long, jaccard double")


def overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs (positions in sets) of distinct values."""
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    shared = count[code] > 1
    owner, code = owner[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros(len(pairs), np.int64)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, WIDTH):
        a, b = np.searchsorted(code, (start, start + WIDTH))
        flags = np.zeros((len(sets), -(-(int(code[b - 1]) + 1 - start) // 64) * 64), bool)
        flags[owner[a:b], code[a:b] - start] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        step = max(1, (1 << 20) // bits.shape[1])
        for k in range(0, len(pairs), step):
            x, y = pairs[k : k + step].T
            out[k : k + step] += np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
    return out


def _linked(rows: pa.Table, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids ascending, linked pairs (positions in the ids) and their Jaccard measures, of one pair of blocks."""
    rows = rows.sort_by("id")
    ids, own, size = (rows[c].to_numpy() for c in ("id", "own", "n_shingles"))
    sketch = np.stack([np.frombuffer(v, np.uint8) for v in rows["sketch"].to_pylist()])
    mixed = rows["x"][0].as_py() != rows["y"][0].as_py()
    out = [np.zeros((0, 2), np.int64)]
    for k in range(len(ids) - 1):
        hit = np.minimum(size[k + 1 :], size[k]) >= threshold * np.maximum(size[k + 1 :], size[k])
        if mixed:
            hit &= own[k + 1 :] != own[k]
        at = k + 1 + np.flatnonzero(hit)
        at = at[np.count_nonzero(sketch[at] == sketch[k], axis=1) >= (threshold - slack) * sketch.shape[1]]
        out.append(np.column_stack([np.full(len(at), k), at]))
    pairs = np.concatenate(out)
    if not len(pairs):
        return ids, pairs, np.zeros(0)
    used, place = np.unique(pairs, return_inverse=True)
    packed = rows["shingles"].take(pa.array(used)).to_pylist()
    sets = [stretch(v, np.uint64, ascending=True) for v in packed]
    sizes = np.array([len(v) for v in sets])
    place = place.reshape(-1, 2)
    both = overlaps(sets, place)
    value = both / (sizes[place].sum(axis=1) - both)
    return ids, pairs[value >= threshold], value[value >= threshold]


def _all_links(labels: DataFrame, links: DataFrame, picked: DataFrame, sets: DataFrame, threshold: float, slack: float) -> tuple[DataFrame, DataFrame]:
    """class_id, n_links; and a, b, jaccard: all links within the groups that `links` connect.

    A group that has all its pairs among the links is done; the others' documents
    are dealt to blocks, and each pair of blocks is compared in one task.
    """
    placed = labels.join(picked.select("doc_id", "n_shingles", "sketch"), "doc_id")
    known = links.join(labels.withColumnRenamed("doc_id", "a"), "a")
    whole = placed.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("volume"))
    found = known.groupBy("group_id").agg(F.count("*").alias("found"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("volume") / VOLUME)).cast("int")
    open_ = lookup(cut(whole.join(found, "group_id").where("2 * found < n * (n - 1)").select("group_id", blocks.alias("blocks"))))

    cells = placed.join(open_, "group_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cells = cells.join(sets, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("group_id", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", F.col("doc_id").alias("id"), "n_shingles", "sketch", "shingles")
    cells = cells.groupBy("group_id", "x", "y")
    count, pair = arrow_schema(links, "class_id long, n long"), arrow_schema(links, "a long, b long, jaccard double")

    def counts(rows: pa.Table) -> pa.Table:
        ids, pairs, _ = _linked(rows, threshold, slack)
        at, n = np.unique(pairs, return_counts=True)
        return pa.table({"class_id": ids[at], "n": n}, schema=count)

    def rows_of(rows: pa.Table) -> pa.Table:
        ids, pairs, value = _linked(rows, threshold, slack)
        return pa.table({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]], "jaccard": value}, schema=pair)

    done = known.join(open_, "group_id", "left_anti").select("a", "b", "jaccard")
    ends = done.select(F.explode(F.array("a", "b")).alias("class_id"), F.lit(1).cast("long").alias("n"))
    degree = ends.union(cells.applyInArrow(counts, "class_id long, n long")).groupBy("class_id").agg(F.sum("n").alias("n_links"))
    return degree, done.union(cells.applyInArrow(rows_of, "a long, b long, jaccard double"))


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> Join:
    """Documents whose sets of word n-grams have a Jaccard measure of `threshold` or more.

    Words are runs of anything but ASCII white space, unchanged; a text of
    fewer than n words has one shingle, of all of them. Null texts and texts
    without a word have none and link to nothing. Equal sets are copies: they
    share a class, and the links are between the classes' smallest ids. Rows
    that share an id must hold the same text; rows without an id are left to themselves (common.numbered gives ids). `recall` is the chance at least
    that a pair at the threshold shares a band. Other columns are not read.
    `n_links` counts the classes that a document's class is linked to, all of
    them; the work for it is quadratic in the classes of a group.
    """
    bands, rows = bands_for(threshold, recall)
    slack = 4 * math.sqrt(0.25 / (bands * rows))
    grey = max(0.0, 2 * threshold - 1)  # under it, the triangle inequality settles a failed pair
    profiles = cut(_profiles(docs.where(F.col(id_col).isNotNull()), id_col, text_col, n, bands, rows))
    some = profiles.where("n_shingles > 0")
    # written, so that the join below is one of two plain shuffles, in which a hot class can be split
    firsts = cut(some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("class_id")))
    members = cut(some.join(firsts, ["s1", "s2", "n_shingles"]).select("doc_id", "class_id").distinct())
    leads = members.where("doc_id = class_id").select("doc_id")

    one_each = some.join(leads, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keys = one_each.select(F.posexplode("bands").alias("band", "key"), F.col("doc_id").alias("id"))
    leader = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    buckets = cut(keys.join(leader, "key").select("key", "band", "a", F.col("id").alias("b")))
    wanted = buckets.select(F.col("b").alias("doc_id")).distinct()
    picked = cut(one_each.join(wanted, "doc_id", "left_semi").select("doc_id", "n_shingles", "bands", "sketch"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = cut(_sets(texts, "doc_id", "text", n))

    led = cut(_verify(buckets.where("a <> b").select("a", "b").distinct(), picked, sets, grey, slack))
    state = F.when((F.col("a") == F.col("b")) | (F.col("jaccard") >= threshold), 2).when(F.col("jaccard").isNotNull(), 1).otherwise(0)
    judged = buckets.join(led, ["a", "b"], "left").select("key", "band", F.col("b").alias("id"), state.alias("state"))
    links = led.where(F.col("jaccard") >= threshold).union(_unsettled(judged, picked, sets, threshold, slack))
    links = cut(links.dropDuplicates(["a", "b"]))
    labels = components(links)
    degree, links = _all_links(labels, links, picked, sets, threshold, slack)
    everyone = docs.select(F.col(id_col).cast("long").alias("doc_id")).join(members, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    groups = everyone.join(labels.withColumnRenamed("doc_id", "class_id"), "class_id", "left").join(degree, "class_id", "left")
    groups = groups.select("doc_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return Join(members, links, groups)


def row_groups(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, class_id, group_id, n_links of every row, whatever its id.

    Rows that share an id, or have none, are separate documents: their class and group are the id of
    the first row there, by id (null ones last) and then by text, and null if that has no id. Ids may be of any type.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, row = numbered(plain, "id", "text")
    groups = ngram_join(rows, n, threshold, recall, row, "text").groups
    if row != "id":
        ids = rows.select(F.col(row).alias("row"), "id")
        for c in ("class_id", "group_id", "doc_id"):
            groups = groups.join(ids.select(F.col("row").alias(c), F.col("id").alias(f"own_{c}")), c).drop(c).withColumnRenamed(f"own_{c}", c)
    return groups.select(F.col("doc_id").alias(id_col), "class_id", "group_id", "n_links")
