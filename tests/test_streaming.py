"""Streams against the same computation in batch."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstack.operators import ops
from quillstack.plans import registry
from quillstack.schema import struct
from quillstack.session import table
from quillstack.sources import commits, sinks
from quillstack.streaming import pipelines
from quillstack.streaming.live import job_states, workflow_states

DATA = "/root/testdata/sf0.001"


def drained(df, name, mode, path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_tumbling_equals_batch(spark, tmp_path):
    events = table(spark, DATA, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{DATA}/events.parquet*")
    live = drained(pipelines.tumbling(stream), "tumbling", "complete", tmp_path / "c")
    batch = registry.queries()["ext_tumbling"](spark, DATA)
    assert {(str(r["start"]), r["n"]) for r in live.collect()} == {(str(r["start"]), r["n"]) for r in batch.collect()}


def at(minutes):
    return datetime(2026, 6, 1) + timedelta(minutes=minutes)


def live(spark, path, batches, kind, follow, **how):
    """Rows of `follow` over files taken one a micro-batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r[:-1], at(r[-1])) for r in rows], kind).coalesce(1).write.parquet(str(path / f"log/{k:02}"))
        for f in (path / f"log/{k:02}").glob("part-*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path / "log"))
    name = "live" + path.name.replace("-", "_")
    found = drained(follow(stream, **how), name, "append", path / "c")
    return sorted(((*r[:-4], round((r["at"] - at(0)).total_seconds() / 60), *r[-3:]) for r in found.collect()), key=repr)


def test_jobs_late_illegal_and_stuck(spark, tmp_path):
    kind = "document_id string, job_type string, status string, at timestamp"
    row = lambda d, s, m: (d, "ocr", s, m)
    batches = [
        [row("late", "running", 2), row("stuck", "pending", 0), row("bad", "done", 1), row("again", "pending", 0), row("again", "failed", 5)],
        [row("late", "pending", 1), row("again", "running", 8), row("again", "pending", 7), row("bad", None, 2)],  # comes later, but in time
        [row("tick", "pending", 100)],  # the watermark goes to 90
        [row("late", "done", 95), row("stuck", "running", 20), row("again", "done", 96)],  # the second is too late
        [row("tick", "running", 300)],
        [row("again", "pending", 295)],  # a final state may not be left
        [row("tick", "done", 500), row("stuck", "running", 495)],
        [row("tick", "done", 5000)],
        [row("late", "pending", 4995)],  # forgotten by now, so it begins anew
        [row("tick", "pending", 6000)],
        [row("tick", "pending", 6100)],
    ]
    found = live(spark, tmp_path, batches, kind, job_states, late="10 minutes", stuck="60 minutes", keep="1000 minutes")
    of = lambda d: [r[2:] for r in found if r[0] == d]
    by_time = lambda rows: sorted(rows, key=lambda r: (r[1], r[-1]))
    assert by_time(of("late")) == [("pending", 1, 1, 0, "ok"), ("running", 2, 1, 0, "ok"), ("running", 62, 1, 0, "stuck"), ("done", 95, 1, 0, "ok"), ("pending", 4995, 1, 0, "ok"), ("pending", 5055, 1, 0, "stuck")]
    assert by_time(of("stuck")) == [("pending", 0, 1, 0, "ok"), ("running", 20, 0, 0, "late"), ("pending", 60, 1, 0, "stuck"), ("running", 495, 1, 0, "ok"), ("running", 555, 1, 0, "stuck")]
    assert by_time(of("bad")) == [("done", 1, 0, 1, "illegal"), (None, 2, 0, 2, "illegal")]
    assert by_time(of("again")) == [("pending", 0, 1, 0, "ok"), ("failed", 5, 1, 0, "ok"), ("pending", 7, 2, 0, "ok"), ("running", 8, 2, 0, "ok"), ("running", 68, 2, 0, "stuck"), ("done", 96, 2, 0, "ok"), ("pending", 295, 2, 1, "illegal")]


def test_workflow_live_equals_batch(spark, tmp_path):
    """Illegal steps are those that the batch check names, as long as each one was refused (a refused step changes nothing live)."""
    rng = random.Random(2)
    steps = ["uploaded", "ocr_pending", "indexed", "under_review", "approved"]
    rows = []
    for d in range(12):
        own = steps if d % 3 else [s for s in steps if s != "ocr_pending"]
        rows += [(f"d{d}", s, 10 * d + k) for k, s in enumerate(own[: rng.randint(1, 5)])]
        if d % 4 == 0:
            rows.append((f"d{d}", "uploaded", 10 * d + 9))
    rng.shuffle(rows)
    half = len(rows) // 2
    found = live(spark, tmp_path, [rows[:half], rows[half:], [("end", "uploaded", 100_000)], [("end", "indexed", 200_000)]], "document_id string, status string, at timestamp", workflow_states, late="1 day", stuck="3650 days")
    flow = spark.createDataFrame(rows, "doc string, state string, at int")
    bad = {(r["doc"], r["at"]) for r in ops.bad_transitions(flow, "doc", "state", ["at"]).collect()}
    assert {(r[0], r[2]) for r in found if r[-1] == "illegal"} == bad and len(bad) == 3
    assert {(r[0], r[1], r[2]) for r in found if r[0] != "end"} == set(rows)


def test_one_upload_for_each_checksum(spark, tmp_path):
    kind = "id string, checksum string, created_at timestamp"
    for k, rows in enumerate([[("a", "x", at(0)), ("b", "x", at(5)), ("c", "y", at(6))], [("d", "x", at(30)), ("e", "z", at(31))]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / f"log/{k}"))
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    rows = drained(pipelines.fresh_uploads(stream), "fresh", "append", tmp_path / "c").collect()
    assert sorted(r["checksum"] for r in rows) == ["x", "y", "z"]


def test_upload_stream_is_idempotent(spark, tmp_path):
    incoming, root = tmp_path / "in", str(tmp_path / "lake")
    incoming.mkdir()
    (incoming / "a.txt").write_text("one two")
    folders = spark.createDataFrame([("f-1", "Inbox")], "id string, name string")
    for k in range(2):  # the second run has a new checkpoint: all files come again
        q = pipelines.ingest_stream(spark, str(incoming), root, folders, str(tmp_path / f"c{k}"), "u-1", "Inbox")
        q.awaitTermination(120)
        (incoming / "b.csv").write_text("a,b")
    assert {r["filename"] for r in sinks.read(spark, root, "documents").collect()} == {"a.txt", "b.csv"}
    assert sinks.read(spark, root, "documents").count() == 2
    assert sinks.read(spark, root, "audit_logs").where(F.col("action") == "upload").count() == 2
    assert sinks.get_bytes(spark, root).count() == 2


def test_upload_that_breaks_off_is_tried_again(spark, tmp_path, monkeypatch):
    incoming, root = tmp_path / "in", str(tmp_path / "lake")
    incoming.mkdir()
    for name, body in {"a.txt": b"one two", "b.exe": b"x", "c.docx": b"no zip", "d.pdf": b"%PDF", "e.png": b"scanned words"}.items():
        (incoming / name).write_bytes(body)
    folders = spark.createDataFrame([("f-1", "Inbox")], "id string, name string")
    broken, all_tables = [], ["raw", "pages", "ocr_results", "document_metadata", "audit_logs", "rejects", "documents"]
    plain, scan = commits.Batch.stage, lambda content: [(1, content.decode(), 0.75)]

    def breaks(batch, df, table, replace=False):
        plain(batch, df, table, replace)
        if table not in broken:  # the rows are written when it breaks off
            broken.append(table)
            raise RuntimeError(f"no {table}")

    monkeypatch.setattr(commits.Batch, "stage", breaks)
    for attempt in range(9):  # each attempt breaks off at the next sink, until none is left
        q = pipelines.ingest_stream(spark, str(incoming), root, folders, str(tmp_path / "c"), "u-1", "Inbox", {"png": scan})
        try:
            q.awaitTermination(120)
            break
        except Exception as e:
            assert "no " in str(e)
            seen = commits.Store(spark, root).snapshot()
            assert seen.number == 0 and all(seen.read(t, struct(t)).count() == 0 for t in all_tables)
    assert broken == all_tables and attempt == 7
    read = lambda t: sinks.read(spark, root, t)
    assert {t: read(t).count() for t in broken if t != "raw"} == {"pages": 2, "ocr_results": 1, "document_metadata": 2, "audit_logs": 2, "rejects": 3, "documents": 2}
    assert {(r["storage_path"][-5:], r["reason"]) for r in read("rejects").collect()} == {("b.exe", "refused"), ("docx"[-5:].rjust(5, "."), "not_parsed"), ("d.pdf", "not_parsed")}
    assert [(r["extracted_text"], r["confidence_score"]) for r in read("ocr_results").collect()] == [("scanned words", 0.75)]
    assert {r["ocr_applied"] for r in read("document_metadata").collect()} == {True, False} and sinks.get_bytes(spark, root).count() == 4
    (incoming / "f.txt").write_text("a new one; those in the catalog are not looked at again")
    q = pipelines.ingest_stream(spark, str(incoming), root, folders.where("false"), str(tmp_path / "other"), "u-1", "Inbox")
    q.awaitTermination(120)
    assert read("rejects").where("reason = 'unknown_folder'").count() == 1 and read("documents").count() == 2
    assert sinks.get_bytes(spark, root).count() == 5


def test_committed_micro_batches_are_not_taken_twice(spark, tmp_path, monkeypatch):
    """The stream stops after the commit and before Spark notes it: the batch is tried again, and nothing is written."""
    incoming, root = tmp_path / "in", str(tmp_path / "lake")
    incoming.mkdir()
    (incoming / "a.txt").write_text("one")
    folders = spark.createDataFrame([("f-1", "Inbox")], "id string, name string")
    plain = commits.Batch.commit

    def stops(batch, relies_on=()):
        plain(batch, relies_on)
        raise RuntimeError("stopped")

    monkeypatch.setattr(commits.Batch, "commit", stops)
    with pytest.raises(Exception, match="stopped"):
        pipelines.ingest_stream(spark, str(incoming), root, folders, str(tmp_path / "c"), "u-1", "Inbox").awaitTermination(120)
    monkeypatch.undo()
    pipelines.ingest_stream(spark, str(incoming), root, folders, str(tmp_path / "c"), "u-1", "Inbox").awaitTermination(120)
    assert commits.Store(spark, root).last() == 1 and sinks.read(spark, root, "documents").count() == 1


def test_manifests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "CHECKPOINT", 3)
    root, schema = str(tmp_path / "s"), StructType.fromDDL("a long, b string")
    rows = lambda *a: spark.createDataFrame([(x, str(x)) for x in a], schema)
    store = commits.Store(spark, root)
    values = lambda snapshot, t="t": sorted(r["a"] for r in snapshot.read(t, schema).collect())
    assert values(store.snapshot()) == [] and store.last() == 0
    for k in range(1, 8):
        batch = store.batch("stream", k)
        assert not batch.done
        batch.stage(rows(k), "t")
        batch.stage(rows(10 * k), "u")
        assert values(store.snapshot()) == list(range(1, k))  # staged rows are not seen
        assert batch.commit() == k
    old = store.snapshot(4)
    assert values(store.snapshot()) == [1, 2, 3, 4, 5, 6, 7] and values(old) == [1, 2, 3, 4] and values(store.snapshot(3), "u") == [10, 20, 30]
    assert store.batch("stream", 7).done and store.batch("stream", 3).done and not store.batch("stream", 8).done and not store.batch("other", 0).done
    opened = []
    read = commits.Store._read
    monkeypatch.setattr(commits.Store, "_read", lambda s, k: opened.append(k) or read(s, k))
    store.snapshot()
    assert opened == [7, 6]  # the sixth repeats all files
    # two at once: additions both get in, but not if one relies on what the other has changed
    one, two, three = store.batch(), store.batch(), store.batch()
    for batch, k in ((one, 100), (two, 101), (three, 102)):
        batch.stage(rows(k), "t")
    assert (one.commit(), two.commit()) == (8, 9)
    with pytest.raises(commits.Conflict):
        three.commit(relies_on=("t",))
    assert values(store.snapshot()) == [1, 2, 3, 4, 5, 6, 7, 100, 101]
    left = store.batch()
    left.stage(rows(7), "v")  # breaks off
    assert commits.swept(store, keep=3600) == 0 and commits.swept(store) == 2
    assert values(store.snapshot()) == [1, 2, 3, 4, 5, 6, 7, 100, 101] and values(old) == [1, 2, 3, 4]
    assert commits.compact(store, "t", schema) == 10 and len(store.snapshot().files["t"]) == 1
    assert values(store.snapshot()) == [1, 2, 3, 4, 5, 6, 7, 100, 101] and values(old) == [1, 2, 3, 4]


def test_append_new_with_another_writer(spark, tmp_path, monkeypatch):
    """What another writer commits between the look and the commit is not added twice."""
    root = str(tmp_path / "s")
    row = lambda *ids: spark.createDataFrame([(i, i, None) for i in ids], "id string, name string, description string")
    plain, others = commits.Batch.stage, ["a"]

    def meanwhile(batch, df, table, replace=False):
        plain(batch, df, table, replace)
        if others:
            sinks.append(row(others.pop()), root, "roles")

    monkeypatch.setattr(commits.Batch, "stage", meanwhile)
    sinks.append_new(row("a", "b", "b"), root, "roles", ["id"])
    assert sorted(r["id"] for r in sinks.read(spark, root, "roles").collect()) == ["a", "b"]
