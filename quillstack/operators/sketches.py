"""Daily sketches of the audit log: made once, kept, and rolled up without reading the log again.

Distinct viewers are HLL sketches, the gaps between actions KLL sketches, and the
most frequent documents counters of a bounded number (Misra-Gries: what a counter lacks is
bounded, and told). All three can be merged, a day's row is some kilobytes however many
rows the day has, and any period is a merge of its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the HLL registers (error about 1.04 / root of them), size of the KLL sketches, counters kept a row.
HLL_BITS, KLL_K, COUNTERS = 14, 400, 64


def _most(pairs: Column, keep: int) -> Column:
    """struct(items, least) of an array of (item, n) with distinct items: the `keep` largest counts, each lessened by the largest that goes; least adds that up."""
    ordered = F.sort_array(F.transform(pairs, lambda x: F.struct((-x["n"]).alias("less"), x["item"].alias("item"))))

    def most(o: Column) -> Column:
        gone = F.when(F.size(o) > keep, -F.get(o, F.lit(keep))["less"]).otherwise(F.lit(0).cast("long"))
        kept = lambda g: F.filter(F.transform(F.slice(o, 1, keep), lambda x: F.struct(x["item"].alias("item"), (-x["less"] - g).alias("n"))), lambda x: x["n"] > 0)
        return F.transform(F.array(gone), lambda g: F.struct(kept(g).alias("items"), g.alias("missed")))[0]

    # one-element arrays bind a value to a lambda's variable: it is sorted once, not for each item that is kept
    return F.transform(F.array(ordered), most)[0]


def daily(log: DataFrame, by: list[str], at: str, viewer: str, item: str, gap: str, pieces: int = 64) -> DataFrame:
    """day, `by`, n, viewers, gaps, frequent, missed: a row for each day and `by`.

    gap: a column of whole numbers (null: none). Counters: items are counted by piece of their hash first, where a piece
    keeps COUNTERS of them, so that no task holds all of a day's items; `missed` is what a counter lacks at most. Null viewers and items are not counted.
    """
    days = log.withColumn("day", F.to_date(at))
    keys = ["day", *by]
    sums = days.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(viewer, F.lit(HLL_BITS)).alias("viewers"), F.kll_sketch_agg_bigint(gap, F.lit(KLL_K)).alias("gaps"))
    counts = days.where(F.col(item).isNotNull()).groupBy(*keys, F.col(item).cast("string").alias("item")).agg(F.count("*").alias("n"))
    dealt = counts.groupBy(*keys, F.pmod(F.xxhash64("item"), F.lit(pieces)).alias("piece")).agg(_most(F.collect_list(F.struct("item", "n")), COUNTERS).alias("most"))
    # pieces have different items, so what is missed is the most that one of them misses, and then what this merge does
    merged = dealt.groupBy(*keys).agg(_most(F.flatten(F.collect_list("most.items")), COUNTERS).alias("most"), F.max("most.missed").alias("missed"))
    frequent = merged.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("most.items").alias("frequent"), (F.col("missed") + F.col("most.missed")).alias("missed"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return sums.join(frequent, same, "left").drop(*(f"__{k}" for k in keys))


def rolled(sketches: DataFrame, by: list[Column]) -> DataFrame:
    """The same columns for longer periods or fewer keys: `by` names them."""
    from pyspark.sql.types import StructField

    names = [StructField(sketches.select(c).columns[0], sketches.select(c).schema[0].dataType).name for c in by]
    keyed = sketches.select(*by, "n", "viewers", "gaps", "frequent", "missed")
    sums = keyed.groupBy(*names).agg(F.sum("n").alias("n"), F.hll_union_agg("viewers").alias("viewers"), F.kll_merge_agg_bigint("gaps").alias("gaps"), F.sum("missed").alias("__missed"))
    items = keyed.select(*names, F.inline("frequent")).groupBy(*names, "item").agg(F.sum("n").alias("n"))
    merged = items.groupBy(*names).agg(_most(F.collect_list(F.struct("item", "n")), COUNTERS).alias("most"))
    frequent = merged.select(*(F.col(k).alias(f"__{k}") for k in names), F.col("most.items").alias("frequent"), F.col("most.missed").alias("__more"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in names]
    joined = sums.join(frequent, same, "left")
    return joined.withColumn("missed", F.col("__missed") + F.coalesce("__more", F.lit(0))).select(*names, "n", "viewers", "gaps", "frequent", "missed")


def viewers(sketch: Column) -> Column:
    """About how many distinct viewers."""
    return F.hll_sketch_estimate(sketch)


def gap_at(sketch: Column, share: float) -> Column:
    """About the gap that the share of gaps does not exceed; null without gaps."""
    return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(share)))
