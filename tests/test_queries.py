"""Every registered query with a SQL twin against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quillstack.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and getattr(v, "ndim", 0)):
            return list(v)
        return None if pd.isna(v) else str(v) if hasattr(v, "isoformat") else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours = registry.queries()[name](spark, DATA).toPandas()
    theirs = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25  # 5 queries of 500 rows, 5 hits each
    assert set(e.oracle_sql()) <= set(e.queries())


def test_approximate_users_are_near(spark):
    exact = {r[0]: r[1] for r in registry.queries()["distinct_users"](spark, DATA).collect()}
    for r in registry.queries()["approx_users"](spark, DATA).collect():
        assert abs(r["n_users"] - exact[r["event_type"]]) <= 0.1 * exact[r["event_type"]] + 1


def test_every_query_block_meets_every_row(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from quillstack.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    asked = vectors.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = {r[0]: np.array(r[1], np.float64) for r in vectors.select("vec_id", "embedding").collect()}
    ids = sorted(rows)
    for limit in (retrieval.BROADCAST_BYTES, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", limit)
        found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in retrieval.top_k(asked, vectors, 3).collect()}
        assert len(found) == 3 * len([i for i in ids if i % 9 == 0])
        for (q, rank), (v, score) in found.items():
            best = sorted(ids, key=lambda i: (-round(float(rows[q] @ rows[i]), 9), i))
            assert abs(rows[q] @ rows[best[rank - 1]] - score) < 1e-9 and abs(rows[q] @ rows[v] - score) < 1e-9
    assert retrieval.top_k(asked.where("false"), vectors, 3).count() == 0 == retrieval.top_k(asked, vectors.where("false"), 3).count()


def recall_of(spark, vectors, k=5):
    """(share of the exact hits found, share of the vectors that are scored exactly for a query)."""
    from pyspark.sql import functions as F

    from quillstack.operators import retrieval, vector_index

    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    codec = vector_index.learn(vectors)
    index = vector_index.encoded(vectors, codec).persist()
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in retrieval.top_k(asked, vectors, k).collect()}
    near = vector_index.search(asked, vectors, index, codec, k).collect()
    assert all(abs(exact[r["query_id"], r["vec_id"]] - r["score"]) == 0 for r in near if (r["query_id"], r["vec_id"]) in exact)
    scored = vector_index.candidates(asked, index, codec, codec.probes, 160).groupBy("query_id").count().agg(F.max("count")).first()[0]
    return len(exact.keys() & {(r["query_id"], r["vec_id"]) for r in near}) / len(exact), scored / vectors.count(), codec


def test_approximate_search_finds_nearly_all(spark):
    d = "/root/testdata/sf0.1"
    recall, scored, _ = recall_of(spark, spark.read.parquet(f"{d}/embeddings.parquet"))
    assert recall >= 0.9 and scored < 0.1, (recall, scored)
    exact = {(r["query_id"], r["vec_id"]) for r in registry.queries()["vector_topk"](spark, d).collect()}
    near = {(r["query_id"], r["vec_id"]) for r in registry.queries()["vector_topk_approximate"](spark, d).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_clustered_vectors_need_few_lists(spark, monkeypatch):
    import numpy as np

    from quillstack.operators import vector_index

    rng = np.random.default_rng(0)
    centers = rng.standard_normal((40, 30))
    rows = [(k, (centers[k % 40] + 0.2 * rng.standard_normal(30)).tolist()) for k in range(4000)]
    rows += [(4001, None), (4003, [1.0]), (4005, [None] * 30), (4007, [float("nan")] * 30)]
    monkeypatch.setattr(vector_index, "LIST", 100)
    monkeypatch.setattr(vector_index, "PIECE", 50)  # lists in several pieces
    recall, scored, codec = recall_of(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert recall >= 0.9 and scored < 0.1 and len(codec.centroids) == 40 and codec.probes <= 10, (recall, scored, codec.probes)
    vectors = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    for corpus in (vectors, vectors.where("false")):
        codec = vector_index.learn(corpus)
        asked = vectors.selectExpr("vec_id as query_id", "embedding")
        assert vector_index.search(asked, corpus, vector_index.encoded(corpus, codec), codec, 5).count() == (9 if corpus is vectors else 0)
        assert vector_index.search(asked.where("false"), corpus, vector_index.encoded(corpus, codec), codec, 5).count() == 0


def test_top_k_ties_and_odd_vectors(spark):
    from quillstack.operators import retrieval

    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.5, 0.0]), ("d", None), ("e", [1.0]), ("f", [None, 1.0]), ("g", [float("nan"), 1.0]), ("h", [])]
    corpus = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [3.0]), (4, [])], "query_id long, embedding array<double>")
    found = sorted(tuple(r) for r in retrieval.top_k(asked, corpus, 2).collect())
    assert found == [(1, "a", 2.0, 1), (1, "b", 2.0, 2), (3, "e", 3.0, 1), (4, "h", 0.0, 1)]
