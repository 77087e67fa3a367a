"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents, in a pseudorandom order, form one stream of words
that is cut into blocks of a fixed length. Each source's quota is a number of
slots. Output shards are filled one after another: each of a shard's places draws a source
by the quotas, so that a shard's source counts are a multinomial draw. What a source draws beyond its quota
is left out, and the last shard takes what is missing, so that quotas are met exactly. A shard's count opens
the source's next slots; slot n of a source takes
block perm(n mod blocks) in epoch n div blocks; perm is a swap-or-not shuffle,
which maps an index to an index and needs no table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, lookup

#: Rounds of the shuffle.
ROUNDS = 16
#: Slots that one row of the plan opens.
RUN = 1024
#: Parts of the range of quotas in which a draw looks for its source.
CELLS = 1024


@dataclass
class Mixture:
    sources: DataFrame  # source, rank, weight, source_size, blocks, target, slots (whole blocks), rest (words of one more)
    counts: DataFrame  # shard, rank, start (the source's first slot there), n: the draws that decide the slots
    slots: DataFrame  # rank, slot, epoch, block, words (null: the whole block), shard
    docs: DataFrame  # doc_id, size, source_size, target, taken


def quotas(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, block_words: int) -> DataFrame:
    """source, source_size -> targets that stop at `most` times the size, the excess reshared by weight.

    Filling up by weight: sources in the order of limit over weight are full
    as long as the level that the others would reach is not below their own.
    One row a source, so the windows here have as many rows as sources.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("full", F.lit(float(most)) * F.col("source_size"))
    by_level = W.orderBy(F.col("full") / F.col("weight"), "rank")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level)
    # the first source, in this order, whose own level is above what is left for it and those after it
    found = found.withColumn("reached", F.min(F.when(F.col("level") < F.col("full") / F.col("weight"), F.struct(F.col("full") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    target = F.when(F.col("reached").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("reached") * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / F.lit(float(block_words))).cast("long")
    per_block = F.col("source_size") / F.col("blocks")
    return (
        found.withColumn("target", target)
        .withColumn("blocks", blocks)
        .withColumn("slots", F.when(F.col("blocks") > 0, F.floor(F.col("target") / per_block + F.lit(1e-9))).otherwise(0).cast("long"))
        .withColumn("rest", F.when(F.col("blocks") > 0, F.round(F.greatest(F.lit(0.0), F.col("target") - F.col("slots") * per_block))).otherwise(0).cast("long"))
        .select("source", "rank", "weight", "source_size", "blocks", "target", "slots", "rest")
    )


def draw(parts: list, digits: int) -> Column:
    """A number of so many hexadecimal digits from the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, digits), 16, 10).cast("long")


def shard_counts(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, rank, start, n: a multinomial draw of sources for each shard, held to the quotas.

    Draws are counted before they are shuffled. A draw finds its source in its
    cell of the range of quotas, which few sources share.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    last = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    width, places = max(1, -(-total // CELLS)), max(1, -(-total // shards))
    ranges = sources.where("slots > 0").select("rank", "slots", F.coalesce(F.sum("slots").over(last), F.lit(0)).alias("low"))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("slots") - 1) / width))))
    places_ = spark.range(0, total, 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1_000_000))
    drawn = places_.select(F.floor(F.col("id") / places).alias("shard"), (draw([F.lit(seed), F.lit("draw"), F.col("id")], 12) % max(1, total)).alias("u"))
    found = drawn.withColumn("cell", F.floor(F.col("u") / width)).join(lookup(cut(cells)), "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.col("slots")))
    counts = cut(found.groupBy("shard", "rank").agg(F.count("*").alias("n")))
    got = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    missing = sources.join(got, "rank", "left").select(F.lit(shards - 1).cast("long").alias("shard"), "rank", (F.col("slots") - F.coalesce("got", F.lit(0))).alias("n")).where("n > 0")
    counts = counts.union(missing).groupBy("shard", "rank").agg(F.sum("n").alias("n")).join(sources.select("rank", "slots"), "rank")
    so_far = F.sum("n").over(W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow))
    held = counts.withColumn("after", F.least(so_far, "slots")).withColumn("start", F.least(so_far - F.col("n"), "slots"))
    return held.select("shard", "rank", "start", (F.col("after") - F.col("start")).alias("n")).where("n > 0")


def slot_plan(sources: DataFrame, counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row a slot: its epoch, block, words and shard.

    A shard's count opens into runs of slots first and runs into slots after a
    shuffle, so that a large source's slots are made by many tasks. A source's
    rest, a part of a block, is a slot of the last shard.
    """
    runs = counts.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    runs = runs.select("rank", "shard", (F.col("start") + F.col("run") * RUN).alias("first"), (F.col("start") + F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1).alias("last"))
    rest = sources.where("rest > 0").select("rank", F.lit(shards - 1).cast("long").alias("shard"), F.col("slots").alias("first"), F.col("slots").alias("last"))
    # so many partitions by name, as the rows are few and small until they are opened
    wanted = sources.agg(F.sum("slots")).first()[0] or 0
    parts = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted // 50_000)
    opened = runs.union(rest).repartition(parts, "rank", "first").select("rank", "shard", F.explode(F.sequence("first", "last")).alias("slot"))
    # what the shuffle's rounds draw depends on source and epoch only
    epochs = sources.where("blocks > 0").select("rank", "blocks", "slots", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("slots") / F.col("blocks")))).alias("epoch"))
    keys = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: draw([F.lit(seed), F.col("rank"), F.col("epoch"), r], 12) % F.col("blocks"))
    rounds = lookup(cut(epochs.withColumn("keys", keys)))
    blocks = lookup(cut(sources.where("blocks > 0").select("rank", F.col("blocks").alias("__blocks"))))
    slots = opened.join(blocks, "rank").withColumn("epoch", F.floor(F.col("slot") / F.col("__blocks"))).join(rounds, ["rank", "epoch"])

    def turn(x: Column, r: Column) -> Column:
        n = F.col("blocks")
        other = (F.get("keys", r - 1) + n - x) % n
        swap = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rank").cast("string"), F.col("epoch").cast("string"), r.cast("string"), F.greatest(x, other).cast("string"))), 1, 1) >= F.lit("8")
        return F.when(swap, other).otherwise(x)

    block = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col("slot") % F.col("blocks"), turn)
    return slots.select("rank", "slot", "epoch", block.alias("block"), F.when(F.col("slot") == F.col("slots"), F.col("rest")).alias("words"), "shard")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 256, shards: int = 64, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mixture:
    """Mixes all documents; one row a document in the result's docs.

    A document's size is its number of words; null texts have 0 and are never
    taken. Sources rank by code point, null last (a source of its own), and
    take the weights in turn; `share` is of all words. A document's words are
    taken at most ceil(most) times. Ties in the pseudorandom order are broken by
    id and size, so equal rows are exchangeable; rows that share an id are
    separate documents. Other columns are not read. Empty input gives no rows.
    `counts` says how many slots of each source a shard takes, `slots` which blocks.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
    )
    sized = cut(sized)
    rows = sized.count()
    sources = cut(quotas(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, block_words))
    small = lookup(sources)

    # places in the streams: a running sum within leaves, over the leaves of a node, and over nodes;
    # the digits follow the row count, so that none of the windows grows beyond some thousand rows
    digits = 1
    while 16 ** (2 * digits) * 1000 < rows:
        digits += 1
    node, leaf = F.substring("key", 1, digits), F.substring("key", 1, 2 * digits)
    ranked = sized.join(small.select(F.col("source").alias("__source"), "rank"), F.col("source").eqNullSafe(F.col("__source"))).select("doc_id", "rank", "size", "key", leaf.alias("leaf"))
    leaves = ranked.groupBy("rank", "leaf").agg(F.sum("size").alias("leaf_size"), F.first(node).alias("node"))
    nodes = leaves.groupBy("rank", "node").agg(F.sum("leaf_size").alias("node_size"))

    def running(size: str, over) -> Column:
        return F.sum(size).over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col(size)

    nodes = nodes.select("rank", "node", running("node_size", W.partitionBy("rank").orderBy("node")).alias("at_node"))
    leaves = leaves.withColumn("at_leaf", running("leaf_size", W.partitionBy("rank", "node").orderBy("leaf")))
    leaves = leaves.join(nodes, ["rank", "node"]).select("rank", "leaf", (F.col("at_leaf") + F.col("at_node")).alias("at"))
    in_leaf = W.partitionBy("rank", "leaf").orderBy("key", "doc_id", "size")
    placed = ranked.withColumn("start", running("size", in_leaf)).withColumn("nth", F.row_number().over(in_leaf))  # (leaf, nth) tells equal rows apart
    placed = placed.join(leaves, ["rank", "leaf"]).select("doc_id", "rank", "size", "leaf", "nth", (F.col("start") + F.col("at")).alias("start"))

    counts = shard_counts(sources, shards, seed)
    slots = slot_plan(sources, counts, shards, seed)
    visits = slots.groupBy("rank", "block").agg(F.count_if(F.col("words").isNull()).alias("whole"), F.max("words").alias("words"))
    last = F.greatest(F.col("start"), F.col("start") + F.col("size") - 1)
    cutting = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor(last / block_words))))
    cutting = cutting.withColumn("from", F.greatest(F.col("start"), F.col("block") * block_words) - F.col("block") * block_words)
    cutting = cutting.withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("block") * block_words)
    # both sides grow with the corpus: the plan's guess of a small side, made before runs are opened, would broadcast one
    met = cutting.join(visits.hint("merge"), ["rank", "block"], "left")
    words = F.coalesce(F.col("whole") * (F.col("to") - F.col("from")), F.lit(0)) + F.greatest(F.lit(0), F.least(F.col("to"), F.coalesce(F.col("words"), F.lit(0))) - F.col("from"))
    taken = met.groupBy("rank", "leaf", "nth", "doc_id", "size").agg(F.sum(F.when(F.col("size") > 0, words).otherwise(0)).alias("taken"))
    result = taken.join(small.select("rank", "source_size", "target"), "rank").select("doc_id", "size", "source_size", "target", "taken")
    return Mixture(sources, counts, slots, result)
