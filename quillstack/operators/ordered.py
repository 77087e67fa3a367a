"""Rows in a total order that no single task has to hold: neighbours, running sums and last known values.

Rows are dealt to ranges of the order, numbered and written, so that the ranges stay
what they are when a task is tried again. Windows run within a range; what a range has to know of those before it
is one row a range, which is joined back. A key with a third of all rows is
many ranges' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut


class Ordered:
    """`df` in the order of `keys` (column names; nulls first), which should tell rows apart, else ties fall either way, but stay so."""

    def __init__(self, df: DataFrame, keys: list[str], number: str | None = None, ranges: int | None = None):
        """number: a column for the rows' numbers, which ascend in the order but leave gaps."""
        spark = df.sparkSession
        ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("__ordinal", F.monotonically_increasing_id())
        placed = placed.withColumn("__range", F.shiftright("__ordinal", 33))
        self.rows = cut(placed.withColumn(number, F.col("__ordinal")) if number else placed)
        self.within = W.partitionBy("__range").orderBy("__ordinal")

    def _carried(self, aggregate: Column, window: W, combine) -> DataFrame:
        """__range, __carry: `combine` over the ranges that `window` reaches; a row for each range, so one task is enough."""
        parts = self.rows.groupBy("__range").agg(aggregate.alias("__part"))
        return F.broadcast(parts.withColumn("__carry", combine(F.col("__part")).over(window)).select("__range", "__carry"))

    def with_next(self, value: Column, name: str) -> DataFrame:
        """With the value of the row that follows; null for the last."""
        heads = self._carried(F.min_by(F.struct(value.alias("v")), "__ordinal"), W.orderBy("__range"), lambda c: F.lead(c))
        own = F.lead(F.struct(value.alias("v"))).over(self.within)
        return self.rows.withColumn("__own", own).join(heads, "__range").withColumn(name, F.coalesce("__own", "__carry")["v"]).drop("__own", "__carry", "__range", "__ordinal")

    def with_running_sum(self, value: Column, name: str) -> DataFrame:
        """With the sum of the values up to the row, itself included."""
        before = self._carried(F.sum(value), W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1), lambda c: F.sum(c))
        own = F.sum(value).over(self.within.rowsBetween(W.unboundedPreceding, W.currentRow))
        return self.rows.withColumn("__own", own).join(before, "__range").withColumn(name, F.col("__own") + F.coalesce("__carry", F.lit(0))).drop("__own", "__carry", "__range", "__ordinal")

    def with_last(self, value: Column, name: str) -> DataFrame:
        """With the last value that is not null, up to the row, itself included."""
        last = lambda c: F.last(c, ignorenulls=True)
        before = self._carried(F.max_by(value, F.when(value.isNotNull(), F.col("__ordinal"))), W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1), last)
        own = last(value).over(self.within.rowsBetween(W.unboundedPreceding, W.currentRow))
        return self.rows.withColumn("__own", own).join(before, "__range").withColumn(name, F.coalesce("__own", "__carry")).drop("__own", "__carry", "__range", "__ordinal")
