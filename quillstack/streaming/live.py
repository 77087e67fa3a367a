"""Jobs and workflows followed live: steps in the order of their time, illegal ones, and what is stuck.

Rows come out of order. A row waits in a list of its key's until the watermark has passed it;
a timer then takes all that have waited so long, in the order of their time, and checks each
step against the graph. A key that stays in an open state for too long is told as stuck,
once for each stay; a key in a final state is forgotten some time later. Both are timers of event time, so
that a stream run again gives the same rows. (Spark's own time to live counts by the clock of
the machine, and not in streams of event time.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import TRANSITIONS

#: Steps that a job may take.
JOB_STEPS: dict[str | None, tuple[str, ...]] = {None: ("pending",), "pending": ("running", "failed"), "running": ("done", "failed"), "failed": ("pending",), "done": ()}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Follow(StatefulProcessor):
    """State of a key: its status since when, how often it began, what was refused, whether it was told as stuck; and the rows that wait."""

    def __init__(self, keys: list[str], graph: dict[str | None, tuple[str, ...]], stuck_ms: int, keep_ms: int):
        self.keys, self.graph, self.stuck_ms, self.keep_ms = keys, graph, stuck_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", "status string, since long, attempts long, rejected long, stuck boolean")
        self.waiting = handle.getListState("waiting", "at long, status string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs(), []
        for batch in rows:
            at = (batch["at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            new = [r for r in zip(at, batch["status"].tolist(), strict=True) if r[0] > passed]
            late += [r for r in zip(at, batch["status"].tolist(), strict=True) if r[0] <= passed]
            if new:
                self.waiting.appendList(new)
            for t in {r[0] for r in new}:
                self.handle.registerTimer(t)
        _, _, attempts, rejected, _ = self.standing.get() if late and self.standing.exists() else (None, 0, 0, 0, False)
        yield self._rows(key, [(status, t, attempts, rejected, "late") for t, status in sorted(late, key=lambda r: (r[0], r[1] or ""))])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        status, since, attempts, rejected, stuck = self.standing.get() if self.standing.exists() else (None, 0, 0, 0, False)
        due, later = [], []
        for row in self.waiting.get():
            (due if row[0] <= now else later).append((row[0], row[1]))
        out = []
        for at, new in sorted(due, key=lambda r: (r[0], r[1] or "")):
            if new in self.graph.get(status, ()):
                attempts += new in self.graph[None]
                status, since, stuck = new, at, False
                out.append((new, at, attempts, rejected, "ok"))
                self.handle.registerTimer(at + (self.stuck_ms if self.graph.get(new) else self.keep_ms))
            else:
                rejected += 1
                out.append((new, at, attempts, rejected, "illegal"))
        if status is not None and self.graph.get(status) and not stuck and now >= since + self.stuck_ms:
            stuck = True
            out.append((status, since + self.stuck_ms, attempts, rejected, "stuck"))
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if status is not None and not self.graph.get(status) and now >= since + self.keep_ms:
            self.standing.clear()  # what still waits comes after that
        else:
            self.standing.update((status, since, attempts, rejected, stuck))
        yield self._rows(key, out)

    def close(self) -> None:
        pass

    def _rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["status", "at", "attempts", "rejected", "verdict"])
        found["at"] = pd.to_datetime(found["at"], unit="ms", utc=True).dt.tz_localize(None)
        for i, k in enumerate(self.keys):
            found.insert(i, k, pd.Series([key[i]] * len(out), dtype="object"))
        return found.astype({"attempts": "int64", "rejected": "int64"})


def _milliseconds(spark, interval: str) -> int:
    return spark.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {interval})").first()[0]


def follow(log: DataFrame, keys: list[str], graph: dict[str | None, tuple[str, ...]], late: str = "1 hour", stuck: str = "6 hours", keep: str = "1 day") -> DataFrame:
    """The keys, status, at, attempts, rejected, verdict of each step, when the watermark has passed it.

    log: the keys, status and at (a timestamp). verdict: 'ok', 'illegal' (the status may not follow the one
    before; it changes nothing), 'stuck' (no legal step for so long after one that has others to follow; `at` is when that was) or
    'late' (the watermark had passed the row when it came; it changes nothing). Rows later by another micro-batch are dropped by Spark. attempts counts first states. A null status is
    illegal. A key in a final state is forgotten after `keep`; what comes then begins anew.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = log.select(*keys, "status", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    out = ", ".join(f"{k} string" for k in keys) + ", status string, at timestamp, attempts long, rejected long, verdict string"
    processor = Follow(keys, graph, _milliseconds(spark, stuck), _milliseconds(spark, keep))
    return timed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def job_states(log: DataFrame, late: str = "1 hour", stuck: str = "6 hours", keep: str = "1 day") -> DataFrame:
    """follow() for jobs: document_id, job_type, status, at."""
    return follow(log, ["document_id", "job_type"], JOB_STEPS, late, stuck, keep)


def workflow_states(log: DataFrame, late: str = "1 hour", stuck: str = "30 days", keep: str = "1 day") -> DataFrame:
    """follow() for documents' workflow: document_id, status, at."""
    return follow(log, ["document_id"], TRANSITIONS, late, stuck, keep)
