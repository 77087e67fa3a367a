"""Jobs, workflow and audit history, all over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..schema import TRANSITIONS
from .ordered import Ordered


def latest_job(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each job."""
    last = W.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return log.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__rank")


def retry(log: DataFrame, keys: list[str], order: list[str], most: int = 3) -> DataFrame:
    """Pending rows to append for jobs whose last row failed, up to so many attempts; the same log gives the same rows."""
    tried = log.groupBy(*keys).agg(F.count_if(F.col("status") == "failed").alias("attempt"))
    failed = latest_job(log, keys, order).where("status = 'failed'").select(*keys)
    return failed.join(tried, keys).where(F.col("attempt") < most).withColumn("status", F.lit("pending"))


def durations(log: DataFrame, keys: list[str], when: str, key: str) -> DataFrame:
    """Microseconds from each row to the next of the same job; null for the last."""
    after = F.lead(when).over(W.partitionBy(*keys).orderBy(when, key))
    return log.withColumn("micros", F.timestamp_diff("MICROSECOND", F.col(when), after))


def concurrency(jobs: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The key, at, running: how many jobs of the key run from each moment on at which that number changes.

    A sweep line: starts and ends, counted by moment before they are moved, are put in one order by key and time, and
    summed over ranges of it with what each range has to know of those before. A job runs from its start until before its
    end; one without an end runs on; one without a start, or that ends before it starts, does not count. At one moment ends and starts are one step.
    """
    fine = jobs.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    step = lambda at, open_, by: F.struct(at.alias("at"), F.lit(open_).alias("open"), F.lit(by).cast("long").alias("by"))
    closing = F.when(F.col(end).isNotNull(), step(F.col(end), 0, -1)).otherwise(step(F.lit(None).cast(fine.schema[end].dataType), 1, -1))
    steps = fine.select(key, F.inline(F.array(step(F.col(start), 0, 1), closing))).groupBy(key, "open", "at").agg(F.sum("by").alias("by")).where("by <> 0")
    # what never ends is closed after all moments, so that every key sums up to nothing and the next one begins at zero
    line = Ordered(steps, [key, "open", "at"]).with_running_sum(F.col("by"), "running")
    return line.where("open = 0").select(key, "at", "running")


def peaks(running: DataFrame, key: str) -> DataFrame:
    """The key, peak, at: the most jobs that ran at once, and since when first."""
    most = F.max_by(F.struct("running", "at"), F.struct("running", -F.unix_micros(F.col("at").cast("timestamp"))))
    return running.groupBy(key).agg(most.alias("m")).select(key, F.col("m.running").alias("peak"), F.col("m.at").alias("at"))


def gaps(log: DataFrame, keys: list[str], when: str, key: str) -> DataFrame:
    """Microseconds since the previous row of the same keys; null for the first."""
    before = F.lag(when).over(W.partitionBy(*keys).orderBy(when, key))
    return log.withColumn("gap_micros", F.timestamp_diff("MICROSECOND", before, F.col(when)))


def running(log: DataFrame, keys: list[str], when: str, key: str) -> DataFrame:
    """Rows of the same keys so far."""
    so_far = W.partitionBy(*keys).orderBy(when, key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return log.withColumn("n_so_far", F.count("*").over(so_far))


def bad_transitions(log: DataFrame, doc: str, state: str, order: list[str]) -> DataFrame:
    """Rows whose state may not follow the document's previous one."""
    before = F.lag(state).over(W.partitionBy(doc).orderBy(*order))
    allowed = F.lit(False)
    for old, new in TRANSITIONS.items():
        came = F.col("__before").eqNullSafe(F.lit(old))
        allowed = allowed | (came & F.col(state).isin(*new) if new else F.lit(False))
    return log.withColumn("__before", before).where(~allowed).withColumnRenamed("__before", "previous")


def audit(df: DataFrame, action: str, user: Column, document: Column, details: Column, at: Column) -> DataFrame:
    """The audit rows that go with a change. Ids follow from the content, so a retried task makes the same ones."""
    rows = df.select(document.cast("string").alias("document_id"), user.cast("string").alias("user_id"), F.lit(action).alias("action"), F.to_json(details).alias("details"), at.cast("timestamp").alias("logged_at"))
    return rows.select(F.sha2(F.concat_ws("|", "document_id", "user_id", "action", "details", F.col("logged_at").cast("string")), 256).alias("id"), "*")


def progress(log: DataFrame, doc: str, job: str, status: str, order: list[str], wanted: list[str]) -> DataFrame:
    """doc, n_done, n_failed, processing: how far each document is, from the last row of each of its jobs.

    processing is 'failed' if some wanted job's last row is, 'indexed' if all wanted jobs are done, else 'processing'.
    """
    last = latest_job(log.where(F.col(job).isin(wanted)), [doc, job], order)
    counts = last.groupBy(doc).agg(F.count_if(F.col(status) == "done").alias("n_done"), F.count_if(F.col(status) == "failed").alias("n_failed"))
    return counts.withColumn("processing", F.when(F.col("n_failed") > 0, "failed").when(F.col("n_done") == len(set(wanted)), "indexed").otherwise("processing"))


def complete(jobs: DataFrame, doc: str, state: str, wanted: list[str]) -> DataFrame:
    """doc, is_complete: whether every wanted state has been seen."""
    seen = F.size(F.collect_set(F.when(F.col(state).isin(wanted), F.col(state))))
    return jobs.groupBy(doc).agg((seen == len(set(wanted))).alias("is_complete"))
