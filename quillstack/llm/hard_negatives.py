"""Hard negatives by bit-sliced integer products.

Components are whole numbers, kept as bit-planes in two's complement. A product
with an anchor is summed plane by plane, the most significant first; what the planes to come can
still add lies between the sums of the anchor's negative and of its positive components, so that each plane
halves the interval of every score. A candidate goes as soon as its interval misses
all that is asked for: the anchor's window of scores, and the score that its k best so far have.

Anchors and rows are packed into blocks, and each pair of blocks is a group. What an
anchor's k best are at least is learned from one block in SEED first; the
others then send on only what can be among them, so that the rows sent on for an anchor
don't grow with the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .chunks import arrow_schema
from .common import cut, numbered
from .vectors import blocks_of, finite, matrix, pack, whole

#: Rows and anchors in a block: at least, at most; and blocks until they grow.
ROWS, ANCHORS = (4096, 1 << 18, 4096), (1024, 1 << 14, 256)
#: One block of so many, at least one, sets the first bounds.
SEED = 64
#: Scores that a task holds at a time, about.
CELLS = 1 << 21
ANY = 1 << 62
ROW_BLOCK = "rows binary, labels binary, planes binary, n_planes int"
ANCHOR_BLOCK = "rows binary, labels binary, parts binary, low binary, high binary"
HIT = "anchor long, part int, row long, score long"


def slices_of(x: np.ndarray) -> np.ndarray:
    """Bit-planes of whole numbers (n x d), the least significant first, the last one the sign: planes x n x bytes of bits."""
    n_planes = 1 + max(int(max(x.max(initial=0), -x.min(initial=0) - 1)).bit_length(), 0)
    return np.stack([np.packbits((x >> j) & 1, axis=1) if x.shape[1] else np.zeros((len(x), 0), np.uint8) for j in range(n_planes)])


def exact_type(planes: int, anchors: np.ndarray) -> type:
    """The fastest type that holds all partial sums exactly."""
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << planes
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def within(planes: np.ndarray, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs with low <= score <= high (one of each per anchor).

    All pairs are summed until few are left; then only these.
    """
    n_planes, n, d = len(planes), planes.shape[1], anchors.shape[1]
    kind = exact_type(n_planes, anchors)
    more, less = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    turned = anchors.T.astype(kind)
    total = np.zeros((n, len(anchors)), kind)
    weight = [(1 << j) * (-1 if j == n_planes - 1 else 1) for j in range(n_planes)]
    j = n_planes
    alive = np.ones(total.shape, bool)
    far = 1 << {np.float32: 24, np.float64: 53, np.int64: 62}[kind]  # beyond all sums
    while j:
        j -= 1
        bits = np.unpackbits(planes[j], axis=1, count=d).astype(kind)
        total += (bits @ turned) * kind(weight[j])
        rest = (1 << j) - 1
        np.logical_and(total >= np.clip(low - rest * more, -far, far).astype(kind), total <= np.clip(high - rest * less, -far, far).astype(kind), out=alive)
        if j and np.count_nonzero(alive) * 16 < alive.size:
            break
    row, anchor = np.nonzero(alive)
    score = total[row, anchor].astype(np.int64)
    while j and len(row):
        j -= 1
        step = max(1, CELLS // max(d, 1))
        for k in range(0, len(row), step):
            bits = np.unpackbits(planes[j][row[k : k + step]], axis=1, count=d)
            score[k : k + step] += weight[j] * np.einsum("ij,ij->i", bits, anchors[anchor[k : k + step]])
        rest = (1 << j) - 1
        left = (score >= low[anchor] - rest * more[anchor]) & (score <= high[anchor] - rest * less[anchor])
        row, anchor, score = row[left], anchor[left], score[left]
    return row, anchor, score


def first_of(group: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, by score from above and then by row."""
    order = np.lexsort((row, -score, group))
    g = group[order]
    start = np.flatnonzero(np.diff(g, prepend=-1))
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


class Blocks:
    """A block of rows and one of anchors, as a group has them."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        d = rows["dim"][0].as_py()
        of = lambda t, c, kind=np.int64: np.frombuffer(t[c][0].as_py(), kind)
        self.row, self.label = of(rows, "rows"), of(rows, "labels")
        self.planes = of(rows, "planes", np.uint8).reshape(rows["n_planes"][0].as_py(), len(self.row), -(-d // 8))
        self.anchor, self.anchor_label = of(anchors, "rows"), of(anchors, "labels")
        m = len(self.anchor)
        self.parts, self.low, self.high = of(anchors, "parts").reshape(m, d), of(anchors, "low").reshape(m, -1), of(anchors, "high").reshape(m, -1)

    def hits(self, same: bool, k: int) -> dict:
        """The first k rows in each window of each anchor, of its label or of others, never itself."""
        out = [[np.zeros(0, np.int64)] * 4]
        for rows, anchors in self._parts(same):
            step = max(1, CELLS // len(anchors))
            found: list = []
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                row, anchor, score = within(self.planes[:, some], self.parts[anchors], self.low[anchors].min(axis=1), self.high[anchors].max(axis=1))
                row, anchor = some[row], anchors[anchor]
                fit = (self.label[row] == self.anchor_label[anchor]) == same
                fit &= self.row[row] != self.anchor[anchor]
                found.append(self._first(row[fit], anchor[fit], score[fit], k))
            both = [np.concatenate(x) for x in zip(*found, strict=True)]
            kept = first_of(both[1] * self.low.shape[1] + both[3], both[2], self.row[both[0]], k)
            out.append([x[kept] for x in both])
        row, anchor, score, part = (np.concatenate(x) for x in zip(*out, strict=True))
        return {"anchor": self.anchor[anchor], "part": part, "row": self.row[row], "score": score}

    def _parts(self, same: bool):
        """(rows, anchors) that may go together: by label, or all."""
        if not same:
            return [(np.arange(len(self.row)), np.arange(len(self.anchor)))] if len(self.row) and len(self.anchor) else []
        return [(np.flatnonzero(self.label == x), np.flatnonzero(self.anchor_label == x)) for x in np.intersect1d(self.label, self.anchor_label)]

    def _first(self, row: np.ndarray, anchor: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
        found = [[np.zeros(0, np.int64)] * 4]
        for part in range(self.low.shape[1]):
            fit = np.flatnonzero((score >= self.low[anchor, part]) & (score <= self.high[anchor, part]))
            fit = fit[first_of(anchor[fit], score[fit], self.row[row[fit]], k)]
            found.append([row[fit], anchor[fit], score[fit], np.full(len(fit), part)])
        return [np.concatenate(x) for x in zip(*found, strict=True)]


def _meet(rows: DataFrame, blocks: int, anchors: DataFrame, groups: int, scale: int, same: bool, k: int) -> DataFrame:
    """HITs of every block of rows and every block of anchors. anchors: row, label, vector, low, high."""
    packed = pack(anchors, groups, lambda t, dim: {
        "rows": [t["row"].to_numpy().tobytes()], "labels": [t["label"].to_numpy().tobytes()], "parts": [whole(matrix(t["vector"], dim), scale).tobytes()],
        "low": [t["low"].combine_chunks().flatten().to_numpy().tobytes()], "high": [t["high"].combine_chunks().flatten().to_numpy().tobytes()],
    }, ANCHOR_BLOCK)
    packed = packed.withColumnRenamed("block", "at").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    arrow = arrow_schema(rows, HIT)
    none = arrow.empty_table()
    by = ("dim", "block", "at")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return pa.table(Blocks(x, y).hits(same, k), schema=arrow) if len(x) and len(y) else none

    return met.groupBy(*by).cogroup(packed.groupBy(*by)).applyInArrow(run, HIT)


def best(rows: DataFrame, blocks: int, anchors: DataFrame, n_anchors: int, scale: int, same: bool, k: int) -> DataFrame:
    """anchor, part, rank, row, score: the first k rows in each window of each anchor."""
    order = W.partitionBy("anchor", "part").orderBy(F.col("score").desc(), "row")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    groups = blocks_of(n_anchors, *ANCHORS)
    seeds = -(-blocks // SEED)
    if seeds < blocks:
        first = ranked(_meet(rows.where(F.col("block") < seeds), seeds, anchors, groups, scale, same, k)).where(F.col("rank") == k)
        floors = first.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("part", "score"))).alias("floors"))  # an entry a window
        lifted = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", i), x)))
        anchors = cut(anchors.join(floors.withColumnRenamed("anchor", "row"), "row", "left").withColumn("low", F.when(F.col("floors").isNull(), F.col("low")).otherwise(lifted)).drop("floors"))
    return ranked(_meet(rows, blocks, anchors, groups, scale, same, k)).select("anchor", "part", F.col("rank").cast("int").alias("rank"), "row", "score")


def hard_negatives(vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the whole product with the
    anchor. An anchor's positives are its first n_positives other rows of its label;
    for each of them come the first n_negatives rows of other labels whose score
    is low to high hundredths of the positive's (low * p <= 100 * n <= high * p). Higher
    scores come first, then smaller ids. `anchors` says which rows are anchors.

    Rows with a null label or vector, or with a null or non-finite component, take no
    part. Rows that share an id are separate rows, and one of them can be the
    other's positive; rows with a null id come after all others. Vectors of another
    length have no product. Labels are whole numbers. A pair without negatives
    has no row. Components of 2^27 / scale and more raise OverflowError. Other columns are
    not read. The work is anchors times rows.
    """
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    used, row = numbered(plain.where(finite("vector") & F.col("label").isNotNull()), "id", "vector")
    used = used.withColumn("row", F.col(row).cast("long"))
    counts = used.agg(F.count("*"), F.count_if("asks")).first()
    blocks = blocks_of(counts[0], *ROWS)

    def planes(t: pa.Table, dim: int) -> dict:
        sliced = slices_of(whole(matrix(t["vector"], dim), scale))
        return {"rows": [t["row"].to_numpy().tobytes()], "labels": [t["label"].to_numpy().tobytes()], "planes": [sliced.tobytes()], "n_planes": [len(sliced)]}

    rows = cut(pack(used.select("row", "label", "vector"), blocks, planes, ROW_BLOCK))
    asked = used.where("asks").select("row", "label", "vector")
    bounds = lambda x: F.array(F.lit(x).cast("long"))
    positives = cut(best(rows, blocks, asked.withColumns({"low": bounds(-ANY), "high": bounds(ANY)}), counts[1], scale, True, n_positives))

    hundredths = lambda x: F.col("score") * F.lit(x).cast("long")
    least, most = hundredths(low), hundredths(high)
    bound = positives.select("anchor", "rank", F.call_function("div", least + F.pmod(-least, F.lit(100)), F.lit(100)).alias("low"), F.call_function("div", most - F.pmod(most, F.lit(100)), F.lit(100)).alias("high"))
    windows = bound.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))  # n_positives at most
    filled = lambda c, none: F.transform(F.sequence(F.lit(0), F.lit(n_positives - 1)), lambda i: F.coalesce(F.get("w", i)[c], F.lit(none).cast("long")))
    asked = asked.join(windows.withColumnRenamed("anchor", "row"), "row").select("row", "label", "vector", filled("low", ANY).alias("low"), filled("high", -ANY).alias("high"))
    negatives = best(rows, blocks, asked, counts[1], scale, False, n_negatives)
    pairs = positives.select("anchor", (F.col("rank") - 1).alias("part"), F.col("row").alias("positive"), F.col("score").alias("positive_score"))
    found = negatives.join(pairs, ["anchor", "part"])
    names = {"anchor_id": F.col("anchor"), "positive_id": F.col("positive"), "negative_id": F.col("row")}
    if row != "id":
        ids = used.select("row", "id")
        for name, c in (("anchor_id", "anchor"), ("positive_id", "positive"), ("negative_id", "row")):
            found = found.join(ids.select(F.col("row").alias(f"__{c}"), F.col("id").alias(name)), F.col(c) == F.col(f"__{c}"))
            names[name] = F.col(name)
    return found.select(names["anchor_id"].alias("anchor_id"), names["positive_id"].alias("positive_id"), "rank", names["negative_id"].alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
