"""Near duplicates of embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its
hash is the axis that it is nearest to, with the sign. Some of these make a
table's key; next to its own key a vector also takes the keys it would nearly have had
(the probes: axes second in size, least loss first). Vectors that share a key in a table meet. How many
hashes a key has follows from the number of vectors, how many tables from the
recall wanted, by the rate at which pairs at the threshold meet.

Equal vectors are one class. What meets is verified in double precision, in blocks
of a bucket, so that a bucket of very many is dealt to many tasks; a pair counts in
the first bucket that it shares. Links are added up in the blocks, and
of their pairs only a spanning forest leaves a block, so that pairs don't become rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import arrow_schema
from .common import cut, lookup, numbered
from .ngram_join import components
from .vectors import finite, matrix

#: Vectors of a bucket in one block; rows of blocks in a group, about.
BLOCK, GROUP = 1024, 16_384
#: Vectors of a label that may share one key by chance, about.
CROWD = 64
#: Axes that are looked at for a key's probes.
NEXT = 4
MEMBER = "row long, weight long, vector binary, keys binary"


@dataclass(frozen=True)
class Family:
    """The hash functions: tables x hashes of three sign vectors each, over `width` (a power of 2) components."""

    dim: int
    hashes: int
    tables: int
    probes: int
    seed: int = 7

    @property
    def width(self) -> int:
        return 1 << max(1, (self.dim - 1).bit_length())

    def signs(self) -> np.ndarray:
        return np.random.default_rng(self.seed).choice(np.array([-1.0, 1.0]), (self.tables, self.hashes, 3, self.width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, by butterflies, scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def keys_of(x: np.ndarray, family: Family) -> np.ndarray:
    """n x tables x (1 + probes): each table's key and its probes, as whole numbers; x has unit rows."""
    full = np.zeros((len(x), family.width))
    full[:, : family.dim] = x
    take = min(NEXT, family.width)
    out = np.empty((len(x), family.tables, 1 + family.probes), np.int64)
    # which of the largest axes each hash takes, the likeliest choices first by their places
    choices = sorted(itertools.product(range(take), repeat=family.hashes), key=lambda c: (sum(c), c))[: 4 * (1 + family.probes)]
    for t, table in enumerate(family.signs()):
        codes, losses = [], []
        for s in table:
            y = turned(full, s)
            size = np.abs(y)
            axis = np.argsort(-size, axis=1, kind="stable")[:, :take]
            top = np.take_along_axis(size, axis, 1)
            codes.append(axis * 2 + (np.take_along_axis(y, axis, 1) < 0))
            losses.append((top[:, :1] - top) ** 2)
        loss = np.stack([sum(losses[h][:, c[h]] for h in range(family.hashes)) for c in choices], axis=1)
        picked = np.argsort(loss, axis=1, kind="stable")[:, : 1 + family.probes]
        key = np.zeros((len(x), len(choices)), np.int64)
        for h in range(family.hashes):
            key = key * (2 * family.width) + codes[h][:, [c[h] for c in choices]]
        own = np.take_along_axis(key, picked, 1)
        if own.shape[1] < out.shape[2]:  # few axes: fewer choices than probes
            own = np.concatenate([own, np.repeat(own[:, :1], out.shape[2] - own.shape[1], axis=1)], axis=1)
        out[:, t] = own
    return out


def family_for(dim: int, crowd: int, threshold: float, recall: float, probes: int = 2, pairs: int = 4000) -> Family:
    """Hashes so that about CROWD of `crowd` vectors share a key by chance; tables so that pairs at the threshold meet with `recall`.

    The rate at which such pairs meet in a table is measured on drawn pairs; a table's rate is taken two standard errors lower.
    """
    width = Family(dim, 1, 1, 0).width
    hashes = max(1, min(8, round(math.log(max(crowd / CROWD, 1), 2 * width))))
    rng = np.random.default_rng(11)
    x = rng.standard_normal((pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, dim))
    if dim > 1:
        y -= np.einsum("ij,ij->i", x, y)[:, None] * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * y
    else:
        y = x
    trial = Family(dim, hashes, 4, probes)
    a, b = keys_of(x, trial), keys_of(y, trial)
    rate = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean()
    rate = min(max(rate - 2 * math.sqrt(max(rate * (1 - rate), 1e-4) / (4 * pairs)), 0.01), 0.999)
    return Family(dim, hashes, max(2, math.ceil(math.log(1 - recall) / math.log(1 - rate))), probes)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows whose cosine is the threshold or more. Pairs next to it are computed once more from the sums themselves."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    value = (x / nx[:, None]) @ (y / ny[:, None]).T
    a, b = np.nonzero(value >= threshold - 1e-9)
    close = np.flatnonzero(value[a, b] < threshold + 1e-9)
    exact = np.array([math.fsum(p * q for p, q in zip(x[i].tolist(), y[j].tolist(), strict=True)) / (math.sqrt(math.fsum(p * p for p in x[i].tolist())) * math.sqrt(math.fsum(q * q for q in y[j].tolist()))) for i, j in zip(a[close], b[close], strict=True)])
    gone = close[exact < threshold] if len(close) else close
    return np.delete(a, gone), np.delete(b, gone)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is connected to by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _share(a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether keys a and b (pairs x tables x keys) have one in common in a table before `before`, the bucket's."""
    found = np.zeros(len(a), bool)
    for t in range(int(before.max(initial=0))):
        found |= (before > t) & (a[:, t, :, None] == b[:, t, None, :]).any(axis=(1, 2))
    return found


def _first(a: np.ndarray, b: np.ndarray, own: int) -> np.ndarray:
    """Whether `own` is the smallest key that two vectors have in common in its table (pairs x keys)."""
    same = a[:, :, None] == b[:, None, :]
    least = np.where(same, a[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
    return least == own


def compare(rows: pa.Table, family: Family, threshold: float, kind: str) -> dict:
    """row, n_links (in this group), root of the rows that have a link in one of the group's cells."""
    rows = rows.sort_by([(c, "ascending") for c in ("label", "table", "key", "x", "y", "row")])
    cells = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("label", "table", "key", "x", "y")], axis=1)
    start = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1))) if len(cells) else np.zeros(0, np.int64)
    row, weight, own, table, key = (rows[c].to_numpy() for c in ("row", "weight", "own", "table", "key"))
    x = np.frombuffer(b"".join(rows["vector"].to_pylist()), kind).reshape(len(row), family.dim).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])  # no square over- or underflows
    keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.int64).reshape(len(row), family.tables, -1)
    out = [[np.zeros(0, np.int64)] * 3]
    for s, e in zip(start, np.append(start[1:], len(row)), strict=True):
        if e - s < 2:
            continue
        if cells[s, 3] == cells[s, 4]:
            a, b = linked(x[s:e], x[s:e], threshold)
            a, b = a[a < b], b[a < b]
        else:
            mine = own[s:e] == cells[s, 3]
            left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
            a, b = linked(x[s:e][left], x[s:e][right], threshold)
            a, b = left[a], right[b]
        if not len(a):
            continue
        root = forest(e - s, a, b)
        links = np.zeros(e - s, np.int64)
        for k in range(0, len(a), 1 << 15):
            p, q = a[k : k + (1 << 15)] + s, b[k : k + (1 << 15)] + s
            new = ~_share(keys[p], keys[q], table[p]) & _first(keys[p, table[s]], keys[q, table[s]], key[s])
            np.add.at(links, p[new] - s, weight[q[new]])
            np.add.at(links, q[new] - s, weight[p[new]])
        used = np.unique(np.concatenate([a, b]))
        out.append([row[s:e][used], links[used], row[s:e][root[used]]])
    got, links, root = (np.concatenate(c) for c in zip(*out, strict=True))
    return {"row": got, "n_links": links, "root": root}


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """The id, n_links, component_id, kept of every row.

    Two vectors of the same label (none if null; any, without a label column) and of the same
    length are linked if their cosine, in double precision, is the threshold or more and
    they meet in some table, which pairs at the threshold do with the chance `recall` at least,
    nearer ones more often. n_links counts the other rows linked directly, equal ones included; component_id is the smallest id that
    links reach, the row's own included, and kept tells that it is the row's own.

    Null and empty vectors, zero vectors and vectors with a null or non-finite component
    have no links. Rows that share an id are separate rows, of which one is kept in a component; a component of
    null ids alone has a null component_id, and one of its rows is kept. Other columns are not read.
    The work for links between unequal vectors is quadratic in a bucket's vectors, in blocks.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), label.alias("label"))
    used, row = numbered(plain, "id", "vector")
    used = used.withColumn("row", F.col(row).cast("long"))
    double = used.schema["vector"].dataType.elementType.simpleString() != "float"
    kind = "<f8" if double else "<f4"
    some = F.exists("vector", lambda x: x != 0)
    whole = used.where(finite("vector") & some & F.col("label").isNotNull()).select("row", F.xxhash64("label").alias("label"), "vector")
    # equal vectors are added up before the shuffle
    classes = cut(whole.groupBy("label", "vector").agg(F.min("row").alias("row"), F.count("*").alias("weight")))
    sizes = classes.groupBy(F.size("vector").alias("dim"), "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("crowd")).collect()  # a row for each length
    parts = [_links(classes.where(F.size("vector") == r["dim"]), family_for(r["dim"], r["crowd"], threshold, recall), threshold, kind) for r in sizes]
    everyone = used.select("row", "id")
    if not parts:
        alone = everyone.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        return alone
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = cut(found)
    degree = found.groupBy("row").agg(F.sum("n_links").alias("n"))
    labels = components(found.where("row <> root").select(F.col("root").alias("a"), F.col("row").alias("b"))).withColumnRenamed("doc_id", "row")
    judged = classes.join(degree, "row", "left").join(labels, "row", "left")
    judged = cut(judged.select("label", "vector", F.coalesce("group_id", "row").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    members = whole.join(judged, ["label", "vector"]).select("row", "root", "n_links")
    out = everyone.join(members, "row", "left").withColumn("root", F.coalesce("root", "row"))
    top = F.col("id") if row == "id" else F.col("top")
    if row == "id":
        out, top = out.withColumn("top", F.col("root").cast(used.schema["id"].dataType)), F.col("top")
    else:
        out = out.join(used.select(F.col("row").alias("root"), F.col("id").alias("top")), "root")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), (F.col("row") == F.col("root")).alias("kept"))


def _links(classes: DataFrame, family: Family, threshold: float, kind: str) -> DataFrame:
    """row, n_links, root: a part of each class's links for each cell it has one in, and whom the cell connects it to."""
    shape = "label long, row long, weight long, vector binary, keys binary"
    arrow = arrow_schema(classes, shape)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                x = matrix(b.column(3), family.dim)
                largest = np.abs(x).max(axis=1, keepdims=True)
                unit = x / largest  # no square over- or underflows
                keys = keys_of(unit / np.linalg.norm(unit, axis=1, keepdims=True), family)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), pa.array([v.tobytes() for v in keys], pa.binary())], schema=arrow)

    members = classes.select("label", "row", "weight", "vector").mapInArrow(hashed, shape)
    return _compared(members, family, threshold, kind)


def _compared(members: DataFrame, family: Family, threshold: float, kind: str) -> DataFrame:
    keys = "label long, row long, table int, key long"
    arrow = arrow_schema(members, keys)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(n, family.tables, -1)
            at, table, _ = (x.ravel() for x in np.indices(own.shape))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(table.astype(np.int32)), pa.array(own.ravel())], schema=arrow)

    members = cut(members)
    places = members.select("label", "row", "keys").mapInArrow(dealt, keys).distinct()  # a vector may have few axes
    bucket = ["label", "table", "key"]
    places = cut(places)
    crowded = lookup(cut(places.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))))
    cells = places.join(crowded, bucket).withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("label", "row", "table", "key", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    cells = cells.join(members.select("row", "weight", "vector", "keys"), "row")
    groups = max(1, -(-members.count() * family.tables * (1 + family.probes) // GROUP))
    cells = cells.withColumn("group", F.pmod(F.xxhash64(*bucket, "x", "y"), F.lit(groups)))
    out = "row long, n_links long, root long"
    arrow_out = arrow_schema(members, out)
    return cells.groupBy("group").applyInArrow(lambda t: pa.table(compare(t, family, threshold, kind), schema=arrow_out), out)
