"""Document fingerprints: spot signatures, in DataFrame operations only.

A spot is a run of common words (anchors); its signature is the run, the
content word after it and the content word after that one. A document's
fingerprint is its set of signature hashes; likeness is the Jaccard measure.
Near copies are found among all fingerprints: these are partitioned by set
length, meet only where a length can reach the threshold and their first
signatures have one in common, and are compared in blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, lookup, numbered

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their "
    "there these they this to was were which will with you "
    "als am auf aus bei das dass dem den der des die ein eine einer er es für im ist mit nach nicht sich sie sind über um und von war wie zu zur "
    "au aux avec ce ces cette dans de du elle en est et il la le les leur mais ne nous ou par pas plus pour qui que sa se ses son sur un une "
    "al como con del el ella entre era esta este la las lo los más no o para pero por se sin su sus y"
)
_JOINT = "\x01"
#: Fingerprints in a block of the comparison.
BLOCK = 1024


def anchors() -> list[str]:
    return sorted(set(ANCHORS.split()))


def segments(text: Column) -> Column:
    """Lower-cased words, each anchor joined to the word after it, so that one segment is a run of anchors and a content word."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    ended = F.transform(words, lambda w: F.concat(w, F.when(w.isin(anchors()), F.lit(_JOINT)).otherwise(F.lit(" "))))
    return F.trim(F.array_join(ended, ""), F.lit(f" {_JOINT}"))


def coded(hash_: Column, letters: Column) -> Column:
    """27 bits of a hash below 4 bits that are smaller the more letters the content words have: longer words are rarer, and stand first in a sorted set."""
    short = F.lit(15) - F.greatest(F.lit(0), F.least(F.lit(15), letters - 8))
    return (F.shiftleft(short.cast("int"), 27) + hash_.bitwiseAND(F.lit((1 << 27) - 1))).cast("int")


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures, as coded hashes (array<int>).

    A text with words but without a whole chain has one signature, of all its
    words; a null text or one without a letter or digit has none.
    """

    def chains(words: Column) -> Column:
        def chain(x: Column, i: Column) -> Column:
            after = F.substring_index(F.get(words, i + 1), _JOINT, -1)
            long = F.length(F.substring_index(x, _JOINT, -1)) + F.length(after)
            return F.when(F.contains(x, F.lit(_JOINT)) & after.isNotNull(), coded(F.hash(x, after), long))

        return F.array_distinct(F.filter(F.transform(words, chain), lambda h: h.isNotNull()))

    def found(joined: Column) -> Column:
        some = F.transform(F.array(F.split(joined, " ")), chains)[0]
        whole = F.when(joined == "", F.array().cast("array<int>")).otherwise(F.array(coded(F.hash(joined), F.length(joined))))
        return F.transform(F.array(some), lambda s: F.when(F.size(s) > 0, F.array_sort(s)).otherwise(whole))[0]

    # one-element arrays bind a value to a lambda's variable: it is made once, not for each access
    return F.transform(F.array(segments(text)), found)[0]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard measure of two sets; two empty sets are alike.

    Sets whose lengths already differ in full (one of them empty) need no look.
    """
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.transform(F.array(both), lambda n: n / (F.size(a) + F.size(b) - n))[0])
    )


def text_of(signature_set: Column) -> Column:
    return F.array_join(signature_set.cast("array<string>"), " ")


def neighbours(ids: DataFrame) -> DataFrame:
    """doc_id, n_chars -> with next_id (ascending; after the last: the first), previous_id and the previous one's length.

    One sort of the ids; what follows looks only within a range partition and
    at the partitions' ends, of which there are as many as partitions.
    """
    placed = ids.orderBy("doc_id").withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed).withColumn("part", F.shiftright("at", 33))
    ends = placed.groupBy("part").agg(
        F.min_by(F.struct("doc_id", "n_chars"), "at").alias("first"), F.max_by(F.struct("doc_id", "n_chars"), "at").alias("last")
    )
    by_part, ring = W.orderBy("part"), W.partitionBy(F.lit(0))
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(by_part), F.min_by("first", "part").over(ring)).alias("after"),
        F.coalesce(F.lag("last").over(by_part), F.max_by("last", "part").over(ring)).alias("before"),
    )
    within = W.partitionBy("part").orderBy("at")
    here = F.struct("doc_id", "n_chars")
    placed = placed.withColumn("lead", F.lead(here).over(within)).withColumn("lag", F.lag(here).over(within))
    return placed.join(F.broadcast(ends), "part").select(
        "doc_id", "n_chars",
        F.coalesce("lead", "after")["doc_id"].alias("next_id"),
        F.coalesce("lag", "before")["doc_id"].alias("previous_id"),
        F.coalesce("lag", "before")["n_chars"].alias("previous_chars"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and signatures of every row; null texts count as empty; equal texts have equal sets."""
    return docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text_col)).alias("signatures"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's signatures against those of its edited text and of the next document.

    doc_id, n_chars, edited, signatures, edited_signatures, near_next (likeness to the
    next document) and class_id (the smallest id with an equal set). The edited text has the last half of the code points (rounded down)
    replaced by as many, or all, of the next document's first ones. Next is
    by ascending id; null ids come last, and rows that share an id follow each other by their texts; a
    sole document is its own next. Null texts count as empty; every row is kept; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts, row = numbered(rows, "doc_id", "text")
    texts = texts.select(F.col(row).alias("row"), "doc_id", "text")
    prints = cut(texts.select("row", "doc_id", F.length("text").cast("long").alias("n_chars"), signatures(F.col("text")).alias("signatures")))
    order = cut(neighbours(prints.select(F.col("row").alias("doc_id"), "n_chars"))).withColumnRenamed("doc_id", "row")
    members, _ = classes(prints)

    known = texts.drop("doc_id").join(order, "row")
    heads = known.select(F.col("previous_id").alias("row"), F.expr("substring(text, 1, cast(floor(previous_chars / 2) as int))").alias("head"))
    # the signatures are made again where the text is, as moving them would take more than making them
    kept = known.select("row", "n_chars", F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))").alias("start"), signatures(F.col("text")).alias("signatures"))
    edited = kept.join(heads, "row").select("row", "n_chars", F.concat("start", "head").alias("edited"), "signatures").join(members.select("row", "class_id"), "row")
    following = prints.join(order.select("row", F.col("previous_id").alias("before")), "row").select(F.col("before").alias("row"), F.col("signatures").alias("next_signatures"))
    found = edited.join(following, "row").select(
        "row", "n_chars", "edited", "signatures", signatures(F.col("edited")).alias("edited_signatures"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"), "class_id",
    )
    if row == "doc_id":
        return found.withColumnRenamed("row", "doc_id")
    return found.join(prints.select("row", "doc_id"), "row").drop("row")


def classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, class_id, c; class_id, c) of prints (row, doc_id, signatures): each row's class of equal sets, its smallest id and the row that stands for it. Sets are told apart by 128 bits."""
    keyed = prints.select("row", "doc_id", F.xxhash64("signatures").alias("h1"), F.xxhash64(F.lit(1), F.reverse("signatures")).alias("h2"))
    # written, so that the join is one of two plain shuffles, in which a hot class can be split
    firsts = cut(keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.min("row").alias("c")))
    return keyed.join(firsts, ["h1", "h2"]).select("row", "class_id", "c"), firsts.select("class_id", "c")


def near_copies(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """row, class_id, n_links, near_id of each row of prints (row, doc_id, signatures; rows are distinct).

    class_id: the smallest id with an equal set (null only if all its ids are). n_links: how many other
    classes have a Jaccard measure of `threshold` (over 0) or more to it; near_id: the smallest of their ids.
    Sets are partitioned by length; a set is at home in its own
    partition and a guest in those after it that the threshold lets its length reach. Two sets meet at
    the first signature that both have among their first, in the order of the number of sets that have a signature: of n, n - ceil(threshold * n) + 1.
    Those that only one set has come first and meet nothing, so that few sets are left and each meets few. What meets at a signature is compared
    in blocks, so that no pair becomes a row; sets that have begun with the same common
    signature have met there already, and signatures at which only such sets meet are left out.
    """
    members, firsts = classes(prints)
    entry = prints.withColumnRenamed("row", "c").join(firsts.select("c"), "c", "left_semi").select("c", F.size("signatures").alias("size"), F.explode("signatures").alias("hash"))

    def part(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / F.lit(math.log(1 / threshold))).cast("int") if threshold < 1 else size.cast("int")

    common = entry.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    # one number that sorts by how many sets have the signature, then by its hash
    ranked = entry.join(common, "hash").select("c", "size", (F.shiftleft("n", 32) + F.col("hash").cast("long").bitwiseAND(0xFFFFFFFF)).alias("signature"))
    own = ranked.groupBy("c", "size").agg(F.sort_array(F.collect_list("signature")).alias("some"))
    # what only this set has stands before the others
    left = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9).cast("int") + 1 - (F.col("size") - F.size("some"))
    starts = cut(own.where(left > 0).select("c", "size", F.slice("some", 1, left).alias("first"), (F.col("size") - F.size("some")).alias("alone")))
    meeting = starts.select("c", "size", F.get("first", F.lit(0)).alias("begin"), "alone", F.posexplode("first").alias("place", "signature"))
    reach = F.sequence(part(F.col("size")), part(F.floor(F.col("size") / threshold + 1e-9)))
    placed = cut(meeting.select("c", "signature", "begin", (F.col("size") - F.col("alone") - F.col("place")).alias("after"), F.posexplode(reach).alias("guest", "part")))
    counted = placed.groupBy("signature", "part").agg(F.count("*").alias("n"), F.count_if(F.col("guest") == 0).alias("home"), F.min("begin").alias("low"), F.max("begin").alias("high"))
    cells = cut(counted.where("n > 1 and home > 0 and (low < high or low = signature)").select("signature", "part", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = placed.join(cells, ["signature", "part"]).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # few sets have neighbours at all; only theirs are moved
    some = lookup(cut(dealt.select("c").distinct()))
    sets = prints.withColumnRenamed("row", "c").join(some, "c", "left_semi").join(firsts.select("c", "class_id"), "c").join(starts.select("c", "size", "first"), "c").select("c", "class_id", "size", "first", "signatures")
    dealt = dealt.join(sets, "c").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    item = F.struct("c", "class_id", "size", "own", "begin", (F.col("guest") > 0).alias("guest"), "after", "first", "signatures")
    groups = dealt.groupBy("signature", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(F.collect_list(item).alias("items")).where(F.size("items") > 1)

    def linked(a: Column) -> Column:
        def near(b: Column) -> Column:
            small, large = F.least(a["size"], b["size"]), F.greatest(a["size"], b["size"])
            shared = F.size(F.array_intersect(a["signatures"], b["signatures"]))
            return (
                (a["c"] != b["c"]) & ~(a["guest"] & b["guest"]) & ((F.col("x") == F.col("y")) | (a["own"] != b["own"]))
                & ((a["begin"] != b["begin"]) | (a["begin"] == F.col("signature"))) & (small >= threshold * large - 1e-9)
                # no more can be shared than what follows in both sets
                & ((1 + threshold) * F.least(a["after"], b["after"]) >= threshold * (small + large) - 1e-9)
                & (F.get(F.array_intersect(a["first"], b["first"]), F.lit(0)) == F.col("signature")) & F.transform(F.array(shared), lambda n: n >= threshold * (small + large - n) - 1e-9)[0]
            )

        close = F.transform(F.filter("items", near), lambda b: b["class_id"])
        return F.transform(F.array(close), lambda ids: F.struct(a["c"].alias("c"), F.size(ids).cast("long").alias("n"), F.array_min(ids).alias("near")))[0]

    found = groups.select(F.inline(F.filter(F.transform("items", linked), lambda r: r["n"] > 0)))
    links = found.groupBy("c").agg(F.sum("n").alias("n_links"), F.min("near").alias("near_id"))
    return members.join(cut(links), "c", "left").select("row", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "near_id")
