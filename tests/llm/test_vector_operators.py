"""Operators 11 to 13 against brute force."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import centroids, embedding_dedup, hard_negatives, vector_queries

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHING = ("id", "row", "vector", "block", "at", "dim", "anchor", "part", "rank", "score", "key", "x", "y", "own", "root", "weight", "group", "distance", "cluster", "total")


def table(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASHING}) if clash else df


def awkward(dim=8, n=260):
    """Clusters, ties, repeated rows, nulls, non-finite numbers, zero and empty vectors, other lengths."""
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((6, dim))
    rows = []
    for k in range(n):
        v = centers[k % 6] + rng.standard_normal(dim) * (0.02 if k % 2 else 0.3)
        rows.append((k, [float(np.float32(x)) for x in v / np.linalg.norm(v)], k % 4))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(0, min(60, n), 4)]  # equal vectors, so tied scores
    rows += [(2000, None, 1), (2100, rows[0][1], None), (2200, [None] * dim, 1), (2300, [math.nan] + [0.0] * (dim - 1), 1), (2400, [math.inf] * dim, 0), (2500, [0.0] * dim, 0), (2600, [], 0), (2601, [], 1), (2700, [0.5, 0.25], 0), (2800, [0.5, 0.25], 1), (2801, [0.5, 0.5], 0)]
    return rows


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, is_anchor, n_positives, n_negatives, low, high):
    """rows have a place of their own, by which ties are broken: (place, id, vector, label)."""
    used = [(p, i, [math.floor(256 * x) for x in v], c) for p, i, v, c in rows if fine(v) and c is not None]
    out = []
    for p, i, v, c in used:
        if i is None or not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), q, j, d) for q, j, w, d in used if q != p and len(w) == len(v))
        for s, _, j, _ in [x for x in scored if x[3] == c][:n_positives]:
            fit = [x for x in scored if x[3] != c and low * -s <= 100 * -x[0] <= high * -s][:n_negatives]
            out += [(i, j, rank, x[2], -s, -x[0]) for rank, x in enumerate(fit, 1)]
    return sorted(out, key=repr)


def test_hard_negatives(spark, monkeypatch):
    rows = awkward()
    want = brute_negatives([(r[0], *r) for r in rows], lambda i: i % 10 == 0, 5, 5, 80, 100)
    assert len({w[0] for w in want}) > 20 and any(w[4] == w[5] for w in want)
    df = table(spark, rows)
    for sizes, seed in (((4096, 1 << 18, 4096), 64), ((40, 40, 4096), 4)):  # in one block, and in many with bounds from some
        monkeypatch.setattr(hard_negatives, "ROWS", sizes)
        monkeypatch.setattr(hard_negatives, "ANCHORS", (9, 9, 256) if sizes[0] == 40 else (1024, 1024, 256))
        monkeypatch.setattr(hard_negatives, "SEED", seed)
        found = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_hard_negatives_of_odd_ids_and_of_nothing(spark):
    rows = awkward(4, 40)
    assert hard_negatives.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(table(spark, rows), F.lit(False)).count() == 0
    assert hard_negatives.hard_negatives(table(spark, [(0, None, 1), (1, [1.0], None)]), F.lit(True)).count() == 0
    # repeated and null ids: rows are told apart by id, then by their vectors, null ids last
    odd = [(r[0] // 2 if r[0] < 1000 else None, *r[1:]) for r in rows if fine(r[1]) and r[2] is not None]
    ordered = sorted(odd, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = brute_negatives([(k, *r) for k, r in enumerate(ordered)], lambda i: i % 5 == 0, 3, 2, 50, 100)
    found = hard_negatives.hard_negatives(table(spark, odd), F.col("vec_id") % 5 == 0, 3, 2, 50, 100)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert [(w[0], w[2], w[4], w[5]) for w in want] == [(g[0], g[2], g[4], g[5]) for g in got]
    named = table(spark, rows).withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    assert {r["anchor_id"] for r in hard_negatives.hard_negatives(named, F.col("vec_id").isin("v0", "v7")).collect()} == {"v0", "v7"}


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9).flatmap(lambda d: st.tuples(st.lists(st.lists(st.integers(-300, 300), min_size=d, max_size=d), min_size=1, max_size=8), st.lists(st.lists(st.integers(-300, 300), min_size=d, max_size=d), min_size=1, max_size=5), st.integers(-90_000, 90_000), st.integers(0, 200_000))))
def test_sliced_products(case):
    x, y, low, width = (np.array(case[0], np.int64), np.array(case[1], np.int64), *case[2:])
    row, anchor, score = hard_negatives.within(hard_negatives.slices_of(x), y, np.full(len(y), low), np.full(len(y), low + width))
    want = {(i, j): int(x[i] @ y[j]) for i in range(len(x)) for j in range(len(y)) if low <= x[i] @ y[j] <= low + width}
    assert dict(zip(zip(row.tolist(), anchor.tolist(), strict=True), score.tolist(), strict=True)) == want


def test_sliced_products_of_large_numbers():
    x, y = np.array([[(1 << 26) - 1] * 64, [-(1 << 26)] * 64], np.int64), np.array([[(1 << 26) - 1] * 64], np.int64)
    _, _, score = hard_negatives.within(hard_negatives.slices_of(x), y, np.array([-hard_negatives.ANY]), np.array([hard_negatives.ANY]))
    assert score.tolist() == [int(v) for v in (x @ y.T)[:, 0]]


def brute_clusters(rows, k, rounds, scale, dim, digest):
    used = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if fine(v) and len(v) == dim]
    c = [v for _, v in sorted(used, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    for _ in range(rounds):
        own = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in used]
        for j in range(len(c)):
            members = [v for (_, v), o in zip(used, own, strict=True) if o == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in used]
    rows = [(i, o, far(v, c[o])) for (i, v), o in zip(used, own, strict=True)]
    one = defaultdict(int)
    for _, o, far_ in rows:
        one[o] += far_
    return sorted((i, o, d, one[o], sum(one.values()), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in rows)


def test_centroids(spark, monkeypatch):
    rows = awkward(8)
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    for blocks in ((4096, 1 << 14, 4096), (30, 30, 4096)):
        monkeypatch.setattr(centroids, "BLOCK", blocks)
        found = centroids.with_inertia(centroids.centroid_clusters(table(spark, rows), 5, 4, dim=8))
        assert sorted(tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == brute_clusters(rows, 5, 4, 1024, 8, digest)
    shared = [(r[0] // 3, *r[1:]) for r in rows]
    found = centroids.with_inertia(centroids.centroid_clusters(table(spark, shared), 3, 2, dim=8))
    assert sorted(tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == brute_clusters(shared, 3, 2, 1024, 8, digest)


def test_centroids_of_few_and_none(spark):
    few = [(1, [1.0] * 64, 0), (None, [0.5] * 64, None), (3, [0.5] * 63, 1)]
    found = centroids.with_inertia(centroids.centroid_clusters(table(spark, few)))
    assert sorted((r["vec_id"] or 0, r["distance"]) for r in found.collect()) == [(0, 0), (1, 0)]
    for none in ([], [(1, None, 1), (2, [1.0], 1), (3, [math.nan] * 64, 0)]):
        assert centroids.with_inertia(centroids.centroid_clusters(table(spark, none))).collect() == []
    with pytest.raises(Exception, match="no exact products"):
        centroids.centroid_clusters(table(spark, [(1, [1e30] * 64, 0), (2, [0.0] * 64, 0)]))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6).flatmap(lambda d: st.tuples(st.lists(st.lists(st.integers(-(1 << 26), 1 << 26), min_size=d, max_size=d), min_size=1, max_size=8), st.lists(st.lists(st.integers(-(1 << 26), 1 << 26), min_size=d, max_size=d), min_size=1, max_size=6))))
def test_screening_is_exact(case):
    x, c = (np.array(v, np.int64) for v in case)
    x = np.concatenate([x, c + 1, c])  # next to ties
    low, high = centroids.intervals(x, c)
    for i in range(len(x)):
        for j in range(len(c)):
            true = sum(int(b) ** 2 - 2 * int(a) * int(b) for a, b in zip(x[i], c[j], strict=True))
            assert low[i, j] <= true <= high[i, j]
    own, distance, _ = centroids.nearest(x, c)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
    assert own.tolist() == [e.index(min(e)) for e in exact] and distance.tolist() == [min(e) for e in exact]


def test_few_vectors_need_exact_numbers():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * rng.standard_normal((4000, 64)) / 8).astype(np.int64)
    assert centroids.nearest(x, x[:8])[2] < 40


def brute_links(rows, threshold):
    used = [(i, v, c) for i, v, c in rows if fine(v) and any(v) and c is not None]
    links = defaultdict(set)
    for a, v, c in used:
        for b, w, d in used:
            if a != b and c == d and len(v) == len(w):
                cos = sum(x * y for x, y in zip(v, w, strict=True)) / (math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(y * y for y in w)))
                if cos >= threshold:
                    links[a].add(b)
    out = []
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


def near(dim, n, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((25, dim))
    spread = [0.02, 0.05, 0.08, 0.11]
    rows = [(k, [float(np.float32(x)) for x in (centers[k % 25] + rng.standard_normal(dim) * spread[k % 4] * np.linalg.norm(centers[k % 25]) / math.sqrt(dim)) * (1 + k % 5)], k % 2) for k in range(n)]
    rows += [(5000 + k, rows[k][1], rows[k][2]) for k in range(0, 90, 5)] + [(6000 + k, [2 * x for x in rows[k][1]], rows[k][2]) for k in range(0, 40, 7)]
    return rows + [(7000, None, 1), (7001, rows[0][1], None), (7002, [0.0] * dim, 0), (7003, [0.0] * dim, 0), (7004, [math.nan] * dim, 0), (7005, [None] * dim, 1), (7006, [], 0), (7007, [], 0), (7008, [-0.0] * dim, 0), (7009, [0.5, 0.5], 1), (7010, [0.5, 0.51], 1), (7011, [1.0], 0), (7012, [3.0], 0), (7013, [-1.0], 0), (7014, [1e-30, 0.0], 0), (7015, [3e38, 0.0], 0)]


def test_embedding_dedup(spark, monkeypatch):
    rows = near(64, 600)
    want = brute_links(rows, 0.98)
    assert sum(w[1] for w in want) > 2000 and any(not w[3] for w in want)
    for block in (1024, 8):  # buckets in one block and in several
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        found = embedding_dedup.embedding_dedup(table(spark, rows))
        assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
        assert sorted(tuple(r) for r in found.collect()) == want
    monkeypatch.setattr(embedding_dedup, "CROWD", 1)  # several hashes in a key, as for many more vectors
    assert embedding_dedup.family_for(64, 50_000, 0.98, 0.9999).hashes == 2
    assert sorted(tuple(r) for r in embedding_dedup.embedding_dedup(table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()) == want


def test_embedding_dedup_of_odd_ids_and_of_nothing(spark):
    assert embedding_dedup.embedding_dedup(table(spark, [])).count() == 0
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = embedding_dedup.embedding_dedup(table(spark, [(1, v, 0), (1, v, 0), (None, v, 0), (None, w, 0), (None, w, 0), (2, None, 0)])).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted((tuple(r) for r in rows), key=key) == sorted([(1, 2, 1, True), (1, 2, 1, False), (None, 2, 1, False), (None, 1, None, True), (None, 1, None, False), (2, 0, 2, True)], key=key)
    alone = embedding_dedup.embedding_dedup(table(spark, [(3, None, 0), (4, [0.0], 0)])).collect()
    assert sorted(tuple(r) for r in alone) == [(3, 0, 3, True), (4, 0, 4, True)]
    named = embedding_dedup.embedding_dedup(spark.createDataFrame([("b", v, "x"), ("a", v, "x"), ("c", v, "y")], "vec_id string, embedding array<float>, label string")).collect()
    assert sorted(tuple(r) for r in named) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def test_recall_at_the_threshold():
    """Drawn pairs at 0.98 meet in some table nearly always, whatever the number of hashes."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= np.einsum("ij,ij->i", x, y)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for crowd in (100, 1_000_000, 100_000_000):
        f = embedding_dedup.family_for(64, crowd, 0.98, 0.9999)
        met = (embedding_dedup.keys_of(x, f)[:, :, :, None] == embedding_dedup.keys_of(y, f)[:, :, None, :]).any(axis=(1, 2, 3))
        assert met.mean() >= 0.999 and f.tables <= 24, (crowd, f)


def test_hadamard():
    x = np.eye(8)
    h = embedding_dedup.hadamard(x)
    assert np.allclose(h @ h, np.eye(8)) and np.allclose(np.abs(h), 1 / math.sqrt(8))


def test_queries_as_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    for name, query in vector_queries.queries().items():
        ours = query(spark, d)
        theirs = con.sql(vector_queries.oracle_sql()[name])
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        assert sorted(tuple(r) for r in ours.select(*columns).collect()) == sorted(theirs.select(*columns).fetchall())
