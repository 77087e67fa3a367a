import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillstack.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, root, words):
    rng = random.Random(12)
    make = lambda n: " ".join(rng.choices(words, k=n))
    texts = {i: make(rng.randint(20, 200)) for i in range(200)}
    labels = {i: 0 for i in texts}
    for i in range(300, 420):
        texts[i], labels[i] = make(30) + " zzslur " + make(5), 1
    near = texts[0].split()[:100] if len(texts[0].split()) >= 100 else make(100).split()
    texts[0] = " ".join(near)
    texts[500] = texts[0]
    texts[501] = " ".join([*near[:-2], "other"])
    passage = make(80)
    texts[502], texts[503] = make(60) + " " + passage + " " + make(60), make(70) + " " + passage + " " + make(70)
    item = make(40)
    texts[504] = make(50) + " " + item + " " + make(50)
    texts[505], texts[506] = "", None
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t) if t is not None else None) for i, t in texts.items()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return texts, passage


def test_stages(spark, tmp_path, words, few):
    root = str(tmp_path)
    texts, passage = write(spark, root, words)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        if k < 4:
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{root}/out/{k}")
        docs = spark.read.parquet(f"{root}/out/{k}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = {i for i in texts if not 300 <= i < 420}
    assert set(seen["toxicity"]) == clean
    assert set(seen["ngram_join"]) == clean - {500, 501}
    cut = seen["substring_dedup"]
    assert set(cut) == clean - {500, 501}
    assert passage in cut[502]["text"] and passage not in cut[503]["text"] and cut[503]["n_chars"] == len(cut[503]["text"])
    assert all(cut[i]["text"] == texts[i] for i in cut if i != 503)
    assert set(seen["decontamination"]) == clean - {500, 501, 504}
    mix = seen["mixing"]
    assert set(mix) == set(seen["decontamination"]) and all(r["taken"] <= 2 * r["size"] for r in mix.values())
    whole = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, root).collect()}
    assert whole == {i: r["taken"] for i, r in mix.items()}


def test_folds_are_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(50).select("id", common.fold_of("id", 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in rows)
    assert spark.createDataFrame([(None,)], "x long").select(common.fold_of("x", 5).alias("f")).where(F.col("f") == 0).count() == 1


AWKWARD = ("score", "predicted", "kept", "n_removed", "n_words", "spans", "id", "chunk", "text_", "__text", "item_id", "rank", "size", "key", "group_id", "seed", "n")


def awkward_documents(spark, words, item):
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choices(words, k=n))
    base, passage = make(120), make(70)
    near = " ".join([*base.split()[:-1], "other"])
    rows = [(1, base), (1, base), (2, near), (None, base), (None, make(30)), (3, None), (3, None), (4, ""), (5, make(40) + " zzslur " + make(20)), (None, "zzslur zzslur " + make(10))]
    rows += [(6, make(60) + " " + passage), (7, passage + " " + make(80)), (None, passage + " " + make(90)), (8, make(60) + " " + item), (None, make(70) + " " + item), (9, "one")]
    texts = dict(base=base, passage=passage)
    docs = spark.createDataFrame([(i, t, "en", None if k % 3 else "s", len(t) if t else 0) for k, (i, t) in enumerate(rows)], COLUMNS)
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(AWKWARD)}), texts


def test_stages_on_awkward_tables(spark, tmp_path, words, few):
    root = str(tmp_path)
    texts, _ = write(spark, root, words)
    item = spark.read.parquet(f"{root}/benchmark.parquet").first()["text"]
    docs, own = awkward_documents(spark, words, item)
    docs.write.parquet(f"{root}/awkward")
    docs = spark.read.parquet(f"{root}/awkward")
    # labels know texts of the large table only: the stage learns from what it is given, so both are given
    large = spark.read.parquet(f"{root}/documents.parquet").where("doc_id between 100 and 400").withColumn("doc_id", F.col("doc_id") + 10_000)
    labels = spark.read.parquet(f"{root}/labels.parquet")
    labels.withColumn("doc_id", F.col("doc_id") + 10_000).write.parquet(f"{root}/more/labels.parquet")
    spark.read.parquet(f"{root}/benchmark.parquet").write.parquet(f"{root}/more/benchmark.parquet")
    both = docs.unionByName(large, allowMissingColumns=True)
    toxic, near, repeats, leaks, mix = (f for _, f in corpus_pipeline.STAGES)
    after = {}
    for name, stage, given in (("toxic", toxic, both), ("near", near, docs), ("repeats", repeats, docs), ("leaks", leaks, docs)):
        out = stage(spark, given, f"{root}/more")
        assert out.columns == docs.columns, name
        after[name] = [r for r in out.collect() if r["doc_id"] is None or r["doc_id"] < 10_000]
        assert all(r[c] == k for r in after[name] for k, c in enumerate(AWKWARD)), name  # clashing columns come through unchanged
    ids = lambda rows: sorted((r["doc_id"] or 99 for r in rows))
    everything = ids(docs.collect())
    assert ids(after["toxic"]) == [i for i in everything if i != 5][:-1]  # 5 and one of those without an id are toxic
    copies = [r for r in after["near"] if r["text"] and r["text"].startswith(own["base"][:60])]
    assert [r["doc_id"] for r in copies] == [1]  # the repeated row, the near copy and the one without an id are gone
    assert sum(r["text"] is None for r in after["near"]) == 2 and len(after["near"]) == len(everything) - 3
    cut = {r["doc_id"]: r["text"] for r in after["repeats"] if r["doc_id"] is not None}
    assert own["passage"] in cut[6] and own["passage"] not in cut[7] and len(after["repeats"]) == len(everything)
    assert sum(own["passage"] in (r["text"] or "") for r in after["repeats"]) == 1
    assert all(item not in (r["text"] or "") for r in after["leaks"]) and len(after["leaks"]) == len(everything) - 2
    assert mix(spark, docs, f"{root}/more").count() == len(everything)
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"{root}/more").count() == 0, name
