"""The folder tree as nested intervals: "at or below" is a range of numbers.

Walking around the tree, a folder is entered and left once. Its entry and exit are numbers of
that walk, so that a folder lies below another if its entry lies between the
other's. The walk is a linked list (a folder is followed by its first child, or left
for its next sibling, or its parent is left), and a step's number is how far it is from the end: found by
pointer doubling, one join a round, in as many rounds as the logarithm of the walk's length, however
deep the tree is. What never reaches the end lies on or below a cycle.

Labels are a derived table, made anew when folders change and read by every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .ordered import Ordered

#: What comes after the walk's last step.
END = -1


def _walk(folders: DataFrame) -> DataFrame:
    """id, number, orphan, child, sibling, parent: numbers of a folder's first child, next sibling and parent."""
    ids = folders.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent_folder_id").alias("parent_id"))
    known = ids.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    placed = ids.join(known, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), (F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("orphan"))
    # children of one folder follow each other in this order, also where they are in several ranges
    numbered = Ordered(placed, ["parent_id", "id"], number="number")
    after = numbered.with_next(F.struct("parent_id", "number"), "after")
    rows = cut(after.withColumn("sibling", F.when(F.col("after.parent_id").eqNullSafe(F.col("parent_id")), F.col("after.number"))).drop("after"))
    first = rows.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.min("number").alias("child"))
    above = rows.select(F.col("id").alias("parent_id"), F.col("number").alias("parent"))
    return rows.join(first, "id", "left").join(above, "parent_id", "left")


def labels(folders: DataFrame) -> DataFrame:
    """id, low, high, depth, root, orphan of every folder that hangs from a top one. folders: id, parent_folder_id.

    Top folders have a null parent, or one that is not there (their trees are
    marked orphan). Of rows that share an id the smallest parent counts; a null id is no folder. Folders on or
    below a cycle have no label (see cyclic), and so nobody can be granted anything through them.
    """
    walk = cut(_walk(folders))
    n = walk.count()
    enter, leave = F.col("number") * 2, F.col("number") * 2 + 1
    then = lambda *c: F.coalesce(*c, F.lit(END)).cast("long")
    steps = F.array(
        F.struct(enter.alias("step"), then(F.col("child") * 2, leave).alias("next"), F.lit(1).cast("long").alias("far"), F.lit(1).cast("long").alias("up")),
        F.struct(leave.alias("step"), then(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("far"), F.lit(-1).cast("long").alias("up")),
    )
    tour = cut(walk.select(F.inline(steps)))
    for _ in range(max(1, 2 * n).bit_length()):
        ahead = tour.select(F.col("step").alias("next"), F.col("next").alias("beyond"), F.col("far").alias("more"), F.col("up").alias("further"))
        doubled = tour.where(F.col("next") != END).join(ahead, "next").select("step", F.col("beyond").alias("next"), (F.col("far") + F.col("more")).alias("far"), (F.col("up") + F.col("further")).alias("up"))
        tour = cut(tour.where(F.col("next") == END).union(doubled))
    ended = tour.where(F.col("next") == END)
    length = ended.count()
    place = ended.select(F.shiftright("step", 1).alias("number"), (F.col("step") % 2).alias("side"), (length - F.col("far")).alias("at"), (-F.col("up")).alias("depth"))
    sides = place.groupBy("number").agg(F.min(F.when(F.col("side") == 0, F.col("at"))).alias("low"), F.min(F.when(F.col("side") == 1, F.col("at"))).alias("high"), F.min(F.when(F.col("side") == 0, F.col("depth"))).alias("depth"))
    found = walk.select("number", "id", "orphan").join(sides, "number").drop("number")
    top = Ordered(found, ["low"]).with_last(F.when(F.col("depth") == 0, F.struct("id", "orphan")), "top")
    return cut(top.select("id", "low", "high", "depth", F.col("top.id").alias("root"), F.col("top.orphan").alias("orphan")))


def cyclic(folders: DataFrame, labelled: DataFrame) -> DataFrame:
    """id of the folders on or below a cycle, to be reported."""
    return folders.where(F.col("id").isNotNull()).select("id").distinct().join(labelled.select("id"), "id", "left_anti")


def outermost(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Ranges that lie in no other one of the same `by`: disjoint, as two intervals of a tree are if neither holds the other."""
    before = W.partitionBy(*by).orderBy("low", F.col("high").desc()).rowsBetween(W.unboundedPreceding, -1)
    return ranges.distinct().withColumn("__reached", F.max("high").over(before)).where(F.col("__reached").isNull() | (F.col("high") > F.col("__reached"))).drop("__reached")


def blocks(low: Column, high: Column, levels: int) -> Column:
    """The fewest aligned blocks of 2^level numbers that make up low to high: an array of (level, block)."""
    start = F.struct(low.alias("a"), (high + 1).alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        open_ = s["a"] < s["b"]
        left, right = open_ & (s["a"] % 2 == 1), open_ & (s["b"] % 2 == 1)
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        one = lambda use, block: F.when(use, F.array(F.struct(level.cast("int").alias("level"), block.cast("bigint").alias("block")))).otherwise(none)
        a, b = s["a"] + left.cast("long"), s["b"] - right.cast("long")
        # where both ends met at one odd block, it is told once
        out = F.concat(s["out"], one(left, s["a"]), one(right & (s["b"] - 1 >= a), s["b"] - 1))
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step)["out"]


def at_or_below(ranges: DataFrame, labelled: DataFrame) -> DataFrame:
    """ranges (low, high and others) with `id` of every folder in them.

    A range join by equal keys: a range is cut into aligned blocks of numbers, two for each level at most, and
    a folder names the block of each level that it is in.
    """
    last = labelled.agg(F.max("high")).first()[0] or 0
    levels = last.bit_length()
    cut_up = ranges.select(*(c for c in ranges.columns if c not in ("low", "high")), F.inline(blocks(F.col("low"), F.col("high"), levels)))
    places = labelled.select("id", "low", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).select("id", "level", F.expr("shiftright(low, level)").alias("block"))
    return cut_up.join(places, ["level", "block"]).drop("level", "block")
