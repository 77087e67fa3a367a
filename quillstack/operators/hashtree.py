"""Hash trees over ranges of keys, to find where two tables differ without comparing their rows.

A leaf is a range of keys, or of their hashes, with the number of its rows and the sum and exclusive or of
their hashes, which are added up before they are moved; a node is the same of FANOUT nodes below. Two trees are compared
from the root down, and only below nodes that differ; a tree has a row for each node, whatever the size of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Nodes below a node, and nodes of a level that are named to the next.
FANOUT, FEW = 16, 1000


def leaf_of(key: Column, leaves: int) -> Column:
    """A leaf by the key's hash."""
    return F.pmod(F.xxhash64(key), F.lit(leaves))


def tree(rows: DataFrame, leaf: Column, *content: Column, height: int = 3) -> DataFrame:
    """level, node, n, total, mixed of every node: level 0 the leaves, `height` the root or roots; written, as it is read level by level. content: what two tables must have in common, the key included."""
    one = F.xxhash64(*content)
    # the sum may pass 64 bits; its halves don't
    hashed = rows.select(leaf.cast("long").alias("node"), one.alias("h"))
    found = hashed.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.shiftright("h", 32) + F.col("h").bitwiseAND(F.lit((1 << 32) - 1))).alias("total"), F.bit_xor("h").alias("mixed"))
    levels = [found.select(F.lit(0).alias("level"), "*")]
    for level in range(1, height + 1):
        up = F.floor(F.col("node") / FANOUT ** level).cast("long").alias("node")
        levels.append(found.groupBy(up).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed")).select(F.lit(level).alias("level"), "*"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return cut(out)


def differing(a: DataFrame, b: DataFrame, height: int = 3) -> DataFrame:
    """node, n_a, n_b of the leaves that differ (n 0: no rows there), found from the root down. Trees should be kept (cut, or stored), for each level reads them.

    Up to FEW nodes that differ in a level are named to the next one's scan; if there are more, the next level is compared in full.
    """

    def compared(level: int, parents: list[int] | None) -> DataFrame:
        sides = []
        for t, n in ((a, "a"), (b, "b")):
            own = t.where(F.col("level") == level)
            if parents is not None:
                own = own.where(F.floor(F.col("node") / FANOUT).cast("long").isin(parents))
            sides.append(own.select("node", F.struct("n", "total", "mixed").alias(n)))
        met = sides[0].join(sides[1], "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        return met.select("node", F.coalesce("a.n", F.lit(0)).cast("long").alias("n_a"), F.coalesce("b.n", F.lit(0)).cast("long").alias("n_b"))

    parents: list[int] | None = None
    for level in range(height, 0, -1):
        nodes = [r[0] for r in compared(level, parents).select("node").limit(FEW + 1).collect()]
        parents = nodes if len(nodes) <= FEW else None
        if not nodes:
            break
    return compared(0, parents)


def drift(expected: DataFrame, indexed: DataFrame, key: str, leaf: Column, leaves_differ: DataFrame) -> DataFrame:
    """key, status ('missing' or 'orphan') of the keys that are in one table only: rows of leaves that differ are joined, the others aren't looked at."""
    some = lambda df: df.select(key, leaf.cast("long").alias("node")).join(leaves_differ.select("node"), "node", "left_semi").select(key).distinct()
    a, b = some(expected), some(indexed)
    missing = a.join(b, key, "left_anti").select(key, F.lit("missing").alias("status"))
    return missing.union(b.join(a, key, "left_anti").select(key, F.lit("orphan")))
