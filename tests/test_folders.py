"""Nested intervals of folder trees, and rows in a total order."""

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from quillstack.operators import folders, guard
from quillstack.operators.ordered import Ordered

TREE = "id string, parent_folder_id string"


def brute(rows):
    """id -> (root, depth, set of all below, itself included); folders on or below a cycle have none."""
    parent = {}
    for i, p in rows:
        if i is not None:
            parent[i] = p if i not in parent or (p is not None and (parent[i] is None or p < parent[i])) else parent[i]
    path, out = {}, {}
    for i in parent:
        seen = [i]
        while (p := parent[seen[-1]]) in parent and p not in seen:
            seen.append(p)
        if p not in seen:
            path[i] = seen
    for i, up in path.items():
        out[i] = (up[-1], len(up) - 1, {j for j, own in path.items() if i in own})
    return out


def awkward(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(f"f{k}", f"f{k - 1}" if 0 < k < 120 else f"f{rng.randrange(k)}" if k > 10 and rng.random() < 0.97 else None) for k in range(n)]
    rows += [(f"hot{k}", "f3") for k in range(200)]  # a third under one parent
    rows += [("a", "b"), ("b", "c"), ("c", "a"), ("under", "c"), ("self", "self"), ("lost", "gone"), ("lost2", "lost"), (None, "f1"), ("f5", "f4"), ("f5", "f4")]
    rng.shuffle(rows)
    return rows


def test_labels(spark):
    rows = awkward()
    want = brute(rows)
    table = spark.createDataFrame(rows, TREE)
    labels = folders.labels(table)
    got = {r["id"]: r for r in labels.collect()}
    assert got.keys() == want.keys() and len({v for r in got.values() for v in (r["low"], r["high"])}) == 2 * len(got)
    assert sorted(v for r in got.values() for v in (r["low"], r["high"])) == list(range(2 * len(got)))
    for i, (root, depth, below) in want.items():
        r = got[i]
        assert (r["root"], r["depth"], r["orphan"]) == (root, depth, i.startswith("lost")), i
        assert {j for j, s in got.items() if r["low"] <= s["low"] <= r["high"]} == below
    assert {r["id"] for r in folders.cyclic(table, labels).collect()} == {"a", "b", "c", "under", "self"}
    asked = ["f0", "f3", "f119", "f300", "lost"]
    ranges = labels.where(F.col("id").isin(asked)).select(F.col("id").alias("of"), "low", "high")
    found = Counter((r["of"], r["id"]) for r in folders.at_or_below(ranges, labels).collect())
    assert found == Counter((i, j) for i in asked if i in want for j in want[i][2])  # each once


def test_labels_of_little(spark):
    assert folders.labels(spark.createDataFrame([], TREE)).count() == 0
    assert folders.at_or_below(spark.createDataFrame([], "low long, high long"), folders.labels(spark.createDataFrame([], TREE))).count() == 0
    assert [tuple(r) for r in folders.labels(spark.createDataFrame([("x", None)], TREE)).collect()] == [("x", 0, 1, 0, "x", False)]
    assert folders.labels(spark.createDataFrame([("x", "y"), ("y", "x")], TREE)).count() == 0


def test_grants_merge_to_disjoint_ranges(spark):
    rows = awkward(seed=2)
    want = brute(rows)
    rng = random.Random(3)
    ids = [i for i, _ in rows if i]
    grants = [(f"r{rng.randrange(6)}", rng.choice(ids), rng.choice(["read", "write", "admin"])) for _ in range(60)] + [("r0", "a", "read"), ("r0", "f0", "own")]
    members = [(f"u{k}", f"r{rng.randrange(6)}") for k in range(8) for _ in range(2)]
    labels = folders.labels(spark.createDataFrame(rows, TREE))
    g, m = spark.createDataFrame(grants, "role_id string, folder_id string, access_level string"), spark.createDataFrame(members, "user_id string, role_id string")
    for required, enough in (("read", {"read", "write", "admin"}), ("write", {"write", "admin"}), ("admin", {"admin"})):
        expected = {(u, j) for u, r in members for q, f, level in grants if q == r and level in enough and f in want for j in want[f][2]}
        found = [tuple(r) for r in guard.effective_folders(m, g, labels, required).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
    ranges = [tuple(r) for r in guard.granted_ranges(m, g, labels).collect()]
    for u, low, high in ranges:
        assert not any(v == u and (a, b) != (low, high) and a <= high and low <= b for v, a, b in ranges)


def test_a_large_deep_tree(spark):
    """300 levels and more. FOLDERS sets the number of folders; 10^6 take some minutes."""
    n = int(os.environ.get("FOLDERS", "60000"))
    up = F.when(F.col("id") == 0, None).when(F.col("id") < 300, F.col("id") - 1).otherwise(F.pmod(F.xxhash64("id"), F.least(F.col("id"), F.lit(300) + F.col("id") / 50).cast("long")))
    table = spark.range(n).select(F.col("id").cast("string").alias("id"), up.cast("string").alias("parent_folder_id"))
    labels = folders.labels(table)
    got = labels.agg(F.count("*"), F.max("depth"), F.min("low"), F.max("high"), F.countDistinct("root"), F.sum((F.col("high") - F.col("low") + 1) / 2)).first()
    assert tuple(got)[:5] == (n, got[1], 0, 2 * n - 1, 1) and got[1] >= 299
    assert got[5] == labels.agg(F.sum(F.col("depth") + 1)).first()[0]  # folders in all subtrees: each is in one for each of its ancestors
    chain = folders.at_or_below(labels.where("id = '299'").select("low", "high"), labels).count()
    whole = labels.where("id = '299'").select(((F.col("high") - F.col("low") + 1) / 2).cast("long")).first()[0]
    assert chain == whole


def test_ordered(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), rng.randrange(50), k, rng.choice([None, None, rng.randrange(100)])) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, at int, n long, value long")
    for ranges in (1, 7):
        ordered = Ordered(df, ["key", "at", "n"], ranges=ranges)
        line = sorted(rows)
        following = {r["n"]: r["next"] for r in ordered.with_next(F.col("n"), "next").collect()}
        assert following == {r[2]: (line[k + 1][2] if k + 1 < len(line) else None) for k, r in enumerate(line)}
        sums = {r["n"]: r["sum"] for r in ordered.with_running_sum(F.coalesce("value", F.lit(0)), "sum").collect()}
        last = {r["n"]: r["last"] for r in ordered.with_last(F.col("value"), "last").collect()}
        total, known = 0, None
        for r in line:
            total, known = total + (r[3] or 0), known if r[3] is None else r[3]
            assert (sums[r[2]], last[r[2]]) == (total, known)
    assert Ordered(df.where("false"), ["n"]).with_next(F.col("n"), "next").count() == 0
