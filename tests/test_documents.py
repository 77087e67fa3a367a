"""Golden fixtures of the document model: permissions, ingestion, extraction, versions, jobs."""

import email
import email.policy
import io
import zipfile
from datetime import datetime
from email.message import EmailMessage

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack import api
from quillstack.functions import text as T
from quillstack.functions.embedding import embed, hashing_encoder
from quillstack.operators import actions, catalog, extraction, fraud, guard, ops, vector_index
from quillstack.plans import files
from quillstack.schema import struct
from quillstack.sources import ingest, parsers, sinks

DATA = "/root/testdata/sf0.001"

FOLDERS = [("f-1", "Invoices", None, "invoices"), ("f-2", "Year", "f-1", "invoices"), ("f-3", "June", "f-2", "invoices"), ("f-4", "Contracts", None, "contracts")]
USER_ROLES = [("x1", "u-1", "r-1"), ("x2", "u-1", "r-2"), ("x3", "u-2", "r-2")]
GRANTS = [("p1", "r-1", "f-1", "read"), ("p2", "r-2", "f-4", "write")]
WHEN = datetime(2026, 6, 1)


def frame(spark, name, rows):
    return spark.createDataFrame(rows, struct(name))


def documents(spark):
    make = lambda i, user, folder, deleted=False: (i, i, i, "pdf", "application/pdf", f"local://b/{i}", "c" + i, user, folder, None, None, deleted, WHEN, WHEN)
    return frame(spark, "documents", [make("d-1", "u-2", "f-3"), make("d-2", "u-2", "f-4"), make("d-3", "u-3", "f-4", True), make("d-4", "u-3", "f-9")])


def test_tree_and_permissions(spark):
    folders = frame(spark, "folders", FOLDERS)
    tree = {(r["root"], r["id"], r["depth"]) for r in guard.folder_tree(folders).collect()}
    assert tree == {("f-1", "f-1", 0), ("f-1", "f-2", 1), ("f-1", "f-3", 2), ("f-4", "f-4", 0)}
    roles, grants = frame(spark, "user_roles", USER_ROLES), frame(spark, "permissions", GRANTS)
    found = guard.effective_folders(roles, grants, folders)
    assert {tuple(r) for r in found.collect()} == {("u-1", f) for f in ("f-1", "f-2", "f-3", "f-4")} | {("u-2", "f-4")}
    writable = guard.effective_folders(roles, grants, folders, "write")
    assert {tuple(r) for r in writable.collect()} == {("u-1", "f-4"), ("u-2", "f-4")}
    docs = documents(spark)
    shown = {r["id"] for r in guard.guarded(docs, roles, grants, folders, "u-2").collect()}
    assert shown == {"d-1", "d-2"}  # d-1 as its owner, d-2 by grant; d-3 is deleted
    assert {r["id"] for r in guard.guarded(docs, roles, grants, folders, "u-9").collect()} == set()


def test_versions_and_soft_delete(spark):
    rows = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("e", 5, "c")], "doc string, at int, name string")
    assert {(r["name"], r["version_number"]) for r in catalog.version_numbers(rows, "doc", ["at"]).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert {r["name"] for r in catalog.current_version(rows, "doc", ["at"]).collect()} == {"b", "c"}
    gone = catalog.soft_deleted(rows, spark.createDataFrame([("d", 3)], "doc string, at int"), "doc", "at")
    assert {(r["doc"], r["is_deleted"]) for r in gone.collect()} == {("d", True), ("e", False)}


def test_values(spark):
    rows = spark.createDataFrame([("4,250.00", "2026-06-14"), ("n/a", "14.6."), (None, None)], "a string, d string")
    found = rows.select(T.amount(F.col("a")).cast("double").alias("a"), T.iso_date(F.col("d")).cast("string").alias("d")).collect()
    assert [tuple(r) for r in found] == [(4250.0, "2026-06-14"), (None, None), (None, None)]
    uri = spark.createDataFrame([("minio://bucket/a/b.pdf",), ("local://b/x",), ("/plain",)], "u string").select(T.storage_uri(F.col("u")).alias("p"))
    assert [tuple(r["p"]) for r in uri.collect()] == [("minio", "bucket", "a/b.pdf"), ("local", "b", "x"), (None, None, None)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=3), max_size=40))
def test_chunks_make_up_the_text(spark, words):
    size, step = 7, 5
    df = spark.createDataFrame([(" ".join(words),)], "t string").select(T.chunks(F.col("t"), size, step).alias("c"))
    chunks = [c.split() for c in df.first()["c"]]
    assert all(len(c) <= size for c in chunks)
    whole = [w for k, c in enumerate(chunks) for w in (c if k == 0 else c[size - step :])]
    assert whole == words


def test_extraction_and_review(spark):
    docs = spark.createDataFrame([(1, "mail a.b@x.com or c@y.org"), (2, ""), (3, None)], "id long, text string")
    found = extraction.extract_fields(docs, "id", "text").collect()
    assert {(r["id"], r["field_value"], r["confidence_score"]) for r in found} == {(1, "a.b@x.com", 0.9), (1, "c@y.org", 0.7)}
    reviews = spark.createDataFrame([(1, 5)], "id long, v long")
    assert {tuple(r) for r in extraction.review_overlay(docs, reviews, "id", "v", F.lit(-1).cast("long")).collect()} == {(1, 5, True), (2, -1, False), (3, -1, False)}


def test_risk_and_gate(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, c string")
    flags = fraud.duplicate_flags(docs, "c", "id")
    scored = fraud.risk(flags, {"dup": (F.col("is_duplicate"), 0.5), "later": (F.col("is_duplicate") & ~F.col("is_first"), 0.9)})
    assert {(r["id"], r["risk_score"]) for r in scored.collect()} == {(1, 0.5), (2, 1.0), (3, 0.0)}
    passed, held = fraud.gate(scored, 0.8)
    assert ({r["id"] for r in passed.collect()}, {r["id"] for r in held.collect()}) == ({1, 3}, {2})


def test_jobs_and_workflow(spark):
    log = spark.createDataFrame([("d", "ocr", 1, "pending"), ("d", "ocr", 2, "failed"), ("e", "ocr", 1, "pending"), ("e", "ocr", 2, "done")], "doc string, job string, at int, status string")
    assert [tuple(r) for r in ops.retry(log, ["doc", "job"], ["at"]).collect()] == [("d", "ocr", 1, "pending")]
    flow = spark.createDataFrame([("d", 1, "uploaded"), ("d", 2, "indexed"), ("d", 3, "approved"), ("e", 1, "indexed")], "doc string, at int, state string")
    assert {(r["doc"], r["at"]) for r in ops.bad_transitions(flow, "doc", "state", ["at"]).collect()} == {("d", 3), ("e", 1)}


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = zipped({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>'})
XLSX = zipped({"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><row><c t="s"><v>0</v></c><c><v>4</v></c></row></s>', "xl/worksheets/sheet2.xml": "<s><row><c><v>9</v></c></row></s>"})
PPTX = zipped({"ppt/slides/slide2.xml": '<p><a:p xmlns:a="a"><a:r><a:t>two</a:t></a:r></a:p></p>', "ppt/slides/slide1.xml": '<x xmlns:a="a"><a:p><a:r><a:t>one</a:t></a:r></a:p></x>'})
EML = b"Subject: Offer\nContent-Type: text/plain\n\nThe body."


def test_parsers():
    assert parsers.docx_pages(DOCX) == [(1, "Hello\nWorld")]
    assert parsers.xlsx_pages(XLSX) == [(1, "name\t4"), (2, "9")]
    assert [n for n, _ in parsers.pptx_pages(PPTX)] == [1, 2]
    assert parsers.eml_pages(EML) == [(1, "Offer\nThe body.")]
    assert parsers.csv_pages(b"a,b\n1,2\n") == [(1, "a\tb\n1\t2")]
    assert parsers.html_pages(b"<p>a</p><script>x</script>") == [(1, "a")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=126), min_size=1, max_size=80), min_size=2, max_size=2), st.sampled_from(["text/plain", "text/html; charset=utf-8", "text/csv", "image/png"]), st.sampled_from(["7bit", "base64", "quoted-printable"]))
def test_plain_messages_read_as_the_email_package_reads_them(cells, kind, coding):
    made = EmailMessage()
    made["Subject"] = cells[0]
    made.set_content(cells[1])
    assert files.eml(cells) == made.as_bytes()
    for content in (made.as_bytes(), f"subject:{cells[0]}\nX-a: b\nContent-Type: {kind}\nContent-Transfer-Encoding: {coding}\n\n{cells[1]}\u00e4\n\nx".encode()):
        message = email.message_from_bytes(content, policy=email.policy.default)
        body = message.get_body(preferencelist=("plain", "html"))
        assert parsers.eml_pages(content) == [(1, f"{message['subject'] or ''}\n{body.get_content() if body is not None else ''}".strip())]
    assert parsers._plain_message(b"Subject: a b\n\nc\n") == ("a b", "c\n")


def test_small_rows_are_parsed_on_all_cores(spark):
    for query in (files.parse_eml, files.parse_pptx, files.parse_xlsx, files.parse_csv, files.parse_html, files.parse_ocr):
        found = query(spark, DATA)
        if query is not files.parse_ocr:
            assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
        assert found.count() > 0


def test_ingest_to_answer(spark, tmp_path):
    for name, body in {"a.txt": b"The invoice total is due in June. More text.", "b.docx": DOCX, "c.pdf": b"%PDF", "d.exe": b"x", "e.eml": EML, "bad.docx": b"no zip"}.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    records, rejected = api.ingest(spark, str(tmp_path / "in"), "u-1", "Invoices")
    assert {r["metadata"]["filename"]: r["source_type"] for r in records.collect()} == {"a.txt": "txt", "b.docx": "docx", "e.eml": "email"}
    reasons = {r["storage_path"].rpartition("/")[2]: r["reason"] for r in rejected.collect()}
    assert reasons["c.pdf"] == "unsupported" and reasons["d.exe"] == "type" and reasons["bad.docx"].startswith("BadZipFile")
    docs, meta, refused = ingest.catalog_rows(records, spark.createDataFrame([("f-1", "Invoices")], "id string, name string"))
    assert docs.count() == meta.count() == 3 and refused.count() == 0
    root = str(tmp_path / "lake")
    sinks.append(docs, root, "documents")
    sinks.append(ingest.upload_audit(docs), root, "audit_logs")
    assert sinks.read(spark, root, "audit_logs").where("action = 'upload'").count() == 3
    raw = ingest.files(spark, str(tmp_path / "in" / "a.txt"))
    sinks.put_bytes(raw, root)
    sinks.put_bytes(raw, root)
    assert sinks.get_bytes(spark, root).count() == 1
    assert {r["intact"] for r in ingest.verify(docs.where("original_filename = 'a.txt'"), sinks.get_bytes(spark, root)).collect()} == {True}
    chunks = ingest.chunk_rows(ingest.page_rows(records))
    effective = spark.createDataFrame([("u-9", "f-1")], "user_id string, folder_id string")
    questions = spark.createDataFrame([(1, "when is the invoice total due")], "query_id long, text string")
    stored = sinks.read(spark, root, "documents")
    sinks.rebuild_vectors(chunks.withColumn("embedding", embed(F.col("chunk"))), root)
    vectors = sinks.read_vectors(spark, root)
    codec = vector_index.learn(api.vector_keys(vectors))
    vector_index.save(codec, vector_index.encoded(api.vector_keys(vectors), codec), f"{root}/index")
    hidden = spark.createDataFrame([], "user_id string, folder_id string")
    for index in (None, vector_index.load(spark, f"{root}/index")):
        found = api.ask(questions, vectors, chunks, stored, effective, "u-9", k=1, index=index).collect()
        assert found[0]["answer"].startswith("The invoice total is due in June.") and found[0]["cited"][0]["page_number"] == 1
        assert api.ask(questions, vectors, chunks, stored, hidden, "u-9", k=1, index=index).count() == 0


def test_contract_reader(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"document_id":"d","source_type":"pdf","storage_path":"minio://b/d.pdf","ocr_applied":true,"pages":[{"page_number":1,"text":"x"},{"page_number":2,"text":""}],"metadata":{"filename":"d.pdf","size_bytes":5,"created_at":"2026-07-09T10:00:00Z"}}\n{"document_id":"e","pages":[]}')
    read = ingest.records(spark, str(tmp_path / "r.json"))
    assert ingest.page_rows(read).count() == 2
    assert read.where("document_id = 'd'").first()["metadata"]["created_at"] == datetime(2026, 7, 9, 10)


def test_encoder_is_unit_norm():
    out = hashing_encoder()(["a b c", ""])
    assert abs(float((out[0] ** 2).sum()) - 1) < 1e-6 and float((out[1] ** 2).sum()) == 0


def test_actions_leave_audit_rows(spark, tmp_path):
    docs, root = documents(spark), str(tmp_path / "lake")
    at = F.lit("2026-07-01").cast("timestamp")
    folders, grants = spark.createDataFrame([("u-9", "f-4")], "user_id string, folder_id string"), spark.createDataFrame([("r-1", "f-4", "read"), ("r-1", "f-4", "own")], "role_id string, folder_id string, access_level string")
    shown, seen = actions.view(guard.not_deleted(docs), folders, "u-9", at)
    store = spark.createDataFrame([("local://b/d-2", b"x"), ("local://b/d-1", b"y")], "storage_path string, content binary")
    files, taken = actions.download(guard.not_deleted(docs), store, folders, "u-9", at)
    gone, deleted = actions.delete(docs, folders, "u-9", at)
    rows, changed = actions.change_permissions(grants, "u-1", at)
    for log in (seen, taken, deleted, changed, ingest.upload_audit(docs), seen):
        actions.record(log, root)
    assert {r["id"] for r in shown.collect()} == {"d-2"} and [tuple(r) for r in files.collect()] == [("d-2", b"x")]
    assert {r["id"] for r in gone.collect()} == {"d-2", "d-3"} and rows.count() == 1
    counts = {r["action"]: r["count"] for r in sinks.read(spark, root, "audit_logs").groupBy("action").count().collect()}
    assert counts == {"view": 1, "download": 1, "delete": 2, "permission_change": 1, "upload": 4}


def test_answerers_are_pluggable(spark):
    hits = spark.createDataFrame([(1, 1, "d", 1, 0.9), (1, 2, "d", 2, 0.5)], "query_id long, rank long, document_id string, page_number int, score double")
    pages = spark.createDataFrame([("d", 1, "First. Second. Third."), ("d", 2, "Other page."), ("d", 3, "Never cited.")], "document_id string, page_number int, text string")
    questions = spark.createDataFrame([(1, "what?")], "query_id long, text string")
    from quillstack.operators import retrieval

    plain = retrieval.answers(hits, pages).first()
    assert plain["answer"] == "First. Second." and [tuple(c) for c in plain["cited"]] == [("d", 1, 0.9), ("d", 2, 0.5)]
    said = retrieval.answers(hits, pages, questions, lambda: lambda qs, cs: [f"{q} {len(c.splitlines())} pages" for q, c in zip(qs, cs, strict=True)]).first()
    assert said["answer"] == "what? 2 pages" and said["cited"] == plain["cited"]
    assert {(r["page_number"], r["excerpt"]) for r in retrieval.citations(hits, pages, 5).collect()} == {(1, "First"), (2, "Other")}


def test_ocr_and_timestamps(spark):
    rows = spark.createDataFrame([("image", [(1, "x")]), ("pdf", [(1, " "), (2, None)]), ("pdf", [(1, ""), (2, "y")]), ("pdf", []), ("pdf", None), ("txt", []), (None, [])], "kind string, pages array<struct<page_number:int,text:string>>")
    assert [r[0] for r in rows.select(T.needs_ocr(F.col("kind"), F.col("pages"))).collect()] == [True, True, False, True, True, False, False]
    at = spark.createDataFrame([("2026-07-09T10:00:00Z",), ("2026-07-09T12:00:00.5+02:00",), ("9.7.2026",), ("2026-07-09",), (None,)], "t string")
    micros = [r[0] for r in at.select(F.unix_micros(T.iso_timestamp(F.col("t")))).collect()]
    assert micros == [1783591200000000, 1783591200500000, None, None, None]
    results = spark.createDataFrame([("d", 0.5), ("d", 1.0), ("e", None)], "document_id string, confidence_score double")
    assert {tuple(r) for r in extraction.ocr_confidence(results).collect()} == {("d", 2, 0.5, 0.75), ("e", 1, None, None)}


def test_known_passages(spark, monkeypatch):
    passage = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, f"x{passage}y"), (2, f"a {passage} b {passage}"), (3, "one two three four five six seven nine"), (4, None), (5, "short bit"), (6, ""), (7, "a b c"), (2, "another row of two")], "id long, text string")
    items = spark.createDataFrame([(10, passage), (11, "ort b"), (12, ""), (13, None), (14, "two three  four five six seven eight"), (15, "wo three fou"), (16, "hort bi"), (17, "b c"), (18, "our f"), (19, "c"), (20, " row of "), (21, "c"), (22, "  ")], "item long, passage string")
    texts, known = [r for r in docs.collect() if r["text"]], [r for r in items.collect() if r["passage"]]
    want = {(d["id"], i["item"]) for d in texts for i in known if i["passage"] in d["text"]}
    assert {(1, 10), (2, 10), (5, 11), (1, 15), (5, 16), (7, 17), (1, 18), (7, 19), (7, 21), (2, 20)} <= want and (3, 10) not in want
    for limit in (fraud.PASSAGE_BYTES, 0):  # broadcast, and by shuffle
        monkeypatch.setattr(fraud, "PASSAGE_BYTES", limit)
        assert {tuple(r) for r in fraud.known_passages(docs, items, "id", "text", "item", "passage").distinct().collect()} == want
    long = items.where("item = 10")
    assert {tuple(r) for r in fraud.known_passages(docs, long, "id", "text", "item", "passage").distinct().collect()} == {(1, 10), (2, 10)}
    assert fraud.known_passages(docs, items.where("false"), "id", "text", "item", "passage").count() == 0 == fraud.known_passages(docs.where("false"), items, "id", "text", "item", "passage").count()


def test_vectors_are_rebuilt_where_chunks_changed(spark, tmp_path):
    from quillstack.sources import vectors
    from quillstack.sources.commits import Store

    store, seen = Store(spark, str(tmp_path / "lake")), spark.sparkContext.accumulator(0)

    def counting():
        plain = hashing_encoder()

        def encode(texts):
            seen.add(len(texts))
            return plain(texts)

        return encode

    rows = [(f"d{k}", 1 + k % 3, k % 5, f"text of chunk {k}") for k in range(2000)]
    frame_of = lambda rows: spark.createDataFrame(rows, "document_id string, page_number int, chunk_index int, chunk string").repartition(3)
    stored = lambda: {tuple(r)[:3]: r["embedding"] for r in vectors.read(store).collect()}

    def embedded(rows):
        before = seen.value
        parts = vectors.rebuild(store, frame_of(rows), counting)
        assert stored() == {r[:3]: hashing_encoder()([r[3] or ""])[0].tolist() for r in rows}
        return len(parts), seen.value - before

    assert embedded(rows) == (vectors.PARTS, 2000)
    number = store.last()
    assert embedded(rows[::-1]) == (0, 0) and store.last() == number  # the same chunks in another order
    rows[7] = (*rows[7][:3], "changed")
    parts, n = embedded(rows)
    assert parts == 1 and n < 100
    parts, n = embedded(rows[:-1])  # one has vanished
    assert parts == 1 and n < 100
    parts, n = embedded([*rows[:-1], ("new", 1, 0, None), ("new", 1, 1, "x")])
    assert parts <= 2 and n < 200
    assert embedded([]) == (vectors.PARTS, 0) and embedded([]) == (0, 0)


def test_hash_trees(spark):
    import random as r

    from quillstack.operators import hashtree

    rng = r.Random(1)
    a = [(k, rng.randrange(5)) for k in range(3000)]
    b = [(k, v + (k == 17)) for k, v in a if k != 2900] + [(5000, 1)]
    make = lambda rows: hashtree.tree(spark.createDataFrame(rows, "id long, v long"), F.floor(F.col("id") / 10), F.col("id"), F.col("v"))
    got = {tuple(x) for x in hashtree.differing(make(a), make(b)).collect()}
    assert got == {(1, 10, 10), (290, 10, 9), (500, 0, 1)}
    assert hashtree.differing(make(a), make(a[::-1])).count() == 0 and hashtree.differing(make([]), make([])).count() == 0


MBOX = b"From a@x Mon\nSubject: One\n\nFirst body\n>From here on\n\nFrom b@x Tue\nSubject: Two\n\nSecond body\n"
MAIL = b'Subject: With files\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\nGr=FC=DFe\n--b\nContent-Type: text/csv\nContent-Disposition: attachment; filename="t.csv"\nContent-Transfer-Encoding: base64\n\nYSxiCjEsMgo=\n--b--\n'


def test_containers_are_unpacked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {"mails.mbox": MBOX, "m.eml": MAIL, "a.zip": zipped({"x/one.txt": "inside", "two.csv": "c,d", "big.txt": "y" * 5000}), "bad.zip": b"no zip", "plain.txt": b"plain"}
    for name, body in files.items():
        (tmp_path / "in" / name).write_bytes(body)
    found = ingest.unpack(ingest.files(spark, str(tmp_path / "in")), max_bytes=1000).collect()
    got = {r["storage_path"].rpartition("/in/")[2]: (r["filename"], r["size_bytes"], r["content"] is None) for r in found}
    assert got.keys() == {"mails.mbox!0", "mails.mbox!1", "m.eml", "m.eml!0/t.csv", "a.zip!x/one.txt", "a.zip!two.csv", "a.zip!big.txt", "bad.zip", "plain.txt"}
    assert got["a.zip!big.txt"] == ("big.txt", 5000, True) and got["m.eml!0/t.csv"] == ("t.csv", 8, False)
    records, rejected = api.ingest(spark, str(tmp_path / "in"), "u-1", "Inbox")
    texts = {r["storage_path"].rpartition("/in/")[2]: r["pages"][0]["text"] for r in records.collect()}
    assert texts["mails.mbox!0"] == "One\nFirst body\nFrom here on" and texts["mails.mbox!1"] == "Two\nSecond body" and texts["m.eml"] == "With files\nGr\u00fc\u00dfe"
    assert texts["m.eml!0/t.csv"] == "a\tb\n1\t2" and texts["a.zip!x/one.txt"] == "inside"
    assert {r["storage_path"].rpartition("/in/")[2]: r["reason"] for r in rejected.collect()} == {"bad.zip": "type"}


def test_dates_in_sheets():
    styles = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    sheet = '<s><row><c><v>46187</v></c><c s="1"><v>46187</v></c><c s="2"><v>46187.5</v></c><c s="3"><v>2.5</v></c><c s="1"/><c s="1" t="str"><v>text</v></c></row></s>'
    assert parsers.xlsx_pages(zipped({"xl/styles.xml": styles, "xl/worksheets/sheet1.xml": sheet})) == [(1, "46187\t2026-06-14\t2026-06-14T12:00:00\t2.5\t\ttext")]


def test_registered_views_are_guarded(spark):
    docs = documents(spark)
    labels = guard.labelled(frame(spark, "folders", FOLDERS))
    mine = guard.guarded(docs, frame(spark, "user_roles", USER_ROLES), frame(spark, "permissions", GRANTS), labels, "u-2")
    guard.register({"my_documents": mine})
    assert {r["id"] for r in spark.sql("SELECT id FROM my_documents WHERE file_type = 'pdf'").collect()} == {"d-1", "d-2"}
