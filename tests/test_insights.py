"""Versions in force, jobs at once, sketches, calibration and extraction rules against brute force."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.operators import catalog, extraction, ops, sketches
from quillstack.plans import insights

DATA = "/root/testdata/sf0.01"


def at(m):
    return None if m is None else datetime(2026, 6, 1) + timedelta(minutes=m)


def test_version_in_force(spark):
    rng = random.Random(1)
    versions = [(rng.choice("aaaab"), at(rng.randrange(200)), k) for k in range(60)] + [("a", None, 900), (None, at(1), 901), ("z", at(0), 902)]
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None]), at(rng.choice([None, *range(200)]))) for k in range(400)]
    found = catalog.in_force(spark.createDataFrame(rows, "id long, key string, at timestamp"), spark.createDataFrame(versions, "key string, since timestamp, n long"), "key", "at", "since")
    got = {r["id"]: r["version"]["n"] if r["version"] else None for r in found.collect()}
    want = {}
    for i, k, t in rows:
        fit = [(s, n) for key, s, n in versions if k is not None and key == k and s is not None and t is not None and s <= t]
        want[i] = max(fit)[1] if fit else None
    assert got == want and set(found.columns) == {"id", "key", "at", "version"}
    assert catalog.in_force(spark.createDataFrame(rows[:5], "id long, key string, at timestamp"), spark.createDataFrame([], "key string, since timestamp, n long"), "key", "at", "since").where("version is not null").count() == 0


def test_concurrency(spark):
    rng = random.Random(2)
    jobs = [(rng.choice("aaab"), at(s := rng.randrange(100)), rng.choice([None, at(s), at(s - 3), at(s + 1), at(s + rng.randrange(1, 60))])) for _ in range(300)] + [("c", None, at(5)), (None, at(1), at(2)), (None, at(1), None)]
    found = ops.concurrency(spark.createDataFrame(jobs, "kind string, start timestamp, ended timestamp"), "kind", "start", "ended")
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want, peaks = [], {}
    for kind in {j[0] for j in jobs}:
        own = [(s, e) for k, s, e in jobs if k == kind and s is not None and (e is None or e > s)]
        before = 0
        for t in sorted({x for s, e in own for x in (s, e) if x is not None}):
            now = sum(s <= t and (e is None or e > t) for s, e in own)
            if now != before:
                want.append((kind, t, now))
            before = now
        mine = [w for w in want if w[0] == kind]
        if mine:
            top = max(w[2] for w in mine)
            peaks[kind] = (top, min(w[1] for w in mine if w[2] == top))
    assert got == sorted(want, key=repr)
    assert {r["kind"]: (r["peak"], r["at"]) for r in ops.peaks(found, "kind").collect()} == peaks


def test_sketches_roll_up(spark):
    """A month's distinct viewers from the days' sketches within 3 % of the truth, its gaps within a rank of 2 %, and counters within what they say they miss."""
    rng = random.Random(3)
    rows = []
    for k in range(60_000):
        user = rng.randrange(20) if rng.random() < 0.3 else rng.randrange(9000)
        rows.append((k, at(rng.randrange(60 * 24 * 60)), f"u{user}" if rng.random() < 0.98 else None, rng.choice(["view", "view", "edit"]), rng.choice([None, int(rng.expovariate(0.001))])))
    log = spark.createDataFrame(rows, "id long, ts timestamp, user string, action string, gap long")
    daily = sketches.daily(log, ["action"], "ts", "user", "user", "gap", pieces=4).persist()
    assert daily.count() == 120 and daily.columns == ["day", "action", "n", "viewers", "gaps", "frequent", "missed"]
    found = sketches.rolled(daily, [F.date_trunc("month", "day").cast("date").alias("month"), F.col("action")])
    out = found.select("month", "action", "n", sketches.viewers(F.col("viewers")).alias("users"), sketches.gap_at(F.col("gaps"), 0.5).alias("half"), sketches.gap_at(F.col("gaps"), 0.9).alias("most"), "frequent", "missed").collect()
    assert len(out) == 4
    for r in out:
        own = [x for x in rows if x[1].date().replace(day=1) == r["month"] and x[3] == r["action"]]
        users, gaps = Counter(x[2] for x in own if x[2]), sorted(x[4] for x in own if x[4] is not None)
        assert r["n"] == len(own) and abs(r["users"] - len(users)) <= 0.03 * len(users)
        for value, share in ((r["half"], 0.5), (r["most"], 0.9)):
            assert abs(sum(g <= value for g in gaps) / len(gaps) - share) <= 0.02
        counted = {x["item"]: x["n"] for x in r["frequent"]}
        assert len(counted) <= sketches.COUNTERS
        for user, n in users.items():
            assert n - r["missed"] <= counted.get(user, 0) <= n
    year = sketches.rolled(sketches.rolled(daily, [F.date_trunc("month", "day").alias("month"), F.col("action")]), [F.year("month").alias("year")]).select(sketches.viewers(F.col("viewers"))).first()[0]
    true = len({x[2] for x in rows if x[2]})
    assert abs(year - true) <= 0.03 * true
    assert sketches.daily(log.where("false"), ["action"], "ts", "user", "user", "gap").count() == 0


def test_each_rule_searches_a_text_once(spark):
    texts = spark.createDataFrame([(1, None), (2, "no field"), (3, "a@b.com 1,234.50 2024-02-30")], "id long, text string")
    found = extraction.extract_fields(texts, "id", "text", extraction.FIELD_RULES)
    assert sorted((r["id"], r["field_name"], r["field_value"]) for r in found.collect()) == [(3, "amount", "1,234.50"), (3, "date", "2024-02-30"), (3, "email", "a@b.com")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == len(extraction.FIELD_RULES)


def test_most_frequent_are_sorted_once(spark):
    rows = [(k, [(f"i{j}", 1 + (7 * j + k) % 11) for j in range(k)]) for k in (0, 1, 3, 4, 9, 200)]
    found = spark.createDataFrame(rows, "k long, pairs array<struct<item:string,n:long>>").select("k", sketches._most(F.col("pairs"), 4).alias("most"))
    for (_, pairs), r in zip(rows, found.orderBy("k").collect(), strict=True):
        ordered = sorted(pairs, key=lambda x: (-x[1], x[0]))
        gone = ordered[4][1] if len(pairs) > 4 else 0
        assert [tuple(x) for x in r["most"]["items"]] == [(i, n - gone) for i, n in ordered[:4] if n > gone] and r["most"]["missed"] == gone
    assert found._jdf.queryExecution().analyzed().toString().count("sort") == 1


def test_viewers_by_month(spark):
    found = {(r["month"], r["event_type"]): r for r in insights.viewers_by_month(spark, DATA).collect()}
    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("date_format(ts, 'yyyy-MM-01') as month", "event_type", "user_id").collect()
    users, n = defaultdict(set), Counter()
    for r in events:
        users[r[0], r[1]].add(r[2])
        n[r[0], r[1]] += 1
    assert found.keys() == users.keys()
    for k, r in found.items():
        assert r["n"] == n[k] and abs(r["n_users"] - len(users[k])) <= 0.03 * len(users[k]) and 0 <= r["gap_median"] <= r["gap_90"]


def brute_isotonic(points):
    """The least-squares fit that never falls: at i the largest over j <= i of the smallest over k >= i of the mean from j to k."""
    mean = lambda j, k: sum(p[2] for p in points[j : k + 1]) / sum(p[1] for p in points[j : k + 1])
    return [max(min(mean(j, k) for k in range(i, len(points))) for j in range(i + 1)) for i in range(len(points))]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 9), st.floats(0, 1)), min_size=1, max_size=14), min_size=1, max_size=12))
def test_pool_adjacent_violators(spark, rules):
    reviews = [(f"r{k}", 3 * i, int(x < round(share * n))) for k, points in enumerate(rules) for i, (n, share) in enumerate(points) for x in range(n)]
    curve = extraction.calibration(spark.createDataFrame([*reviews, ("r0", None, 1), ("r0", 0, None)], "rule string, score long, right long"), "rule", "score", "right")
    got = {(r["rule"], r["score"]): r["confidence"] for r in curve.collect()}
    for k, points in enumerate(rules):
        whole = [(3 * i, n, round(share * n)) for i, (n, share) in enumerate(points)]
        for (score, _, _), want in zip(whole, brute_isotonic(whole), strict=True):
            assert abs(got[f"r{k}", score] - want) < 1e-12
    asked = spark.createDataFrame([("r0", -5), ("r0", 1), ("r0", 10_000), ("none", 3)], "rule string, score long")
    value = {(r["rule"], r["score"]): r["confidence"] for r in extraction.calibrated(asked, curve, "rule", "score").collect()}
    last = max(s for r, s in got if r == "r0")
    assert value == {("r0", -5): got["r0", 0], ("r0", 1): got["r0", 0], ("r0", 10_000): got["r0", last], ("none", 3): None}


def test_field_rules(spark):
    text = 'Mail a.b@x.com, card 4111111111111111 or 4111111111111112 (not 41111111111111111), host 10.0.0.255 not 1.2.3.4.5 but 300.1.1.1, token = "%s" key: %s due 2026-06-14 or 2026-13-40, total 4,250.00 and 12.50; call +49 30 1234 5678.' % ("a" * 40, "b" * 17)
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    found = {(r["field_name"], r["field_value"]): r["confidence_score"] for r in extraction.extract_fields(docs, "id", "text", extraction.FIELD_RULES).collect()}
    assert found == {
        ("email", "a.b@x.com"): 0.9, ("card", "4111111111111111"): 0.95, ("card", "4111111111111112"): 0.4, ("address", "10.0.0.255"): 0.9, ("address", "300.1.1.1"): 0.2,
        ("secret", "a" * 40): 0.95, ("secret", "b" * 17): 0.6, ("date", "2026-06-14"): 0.95, ("date", "2026-13-40"): 0.1, ("amount", "4,250.00"): 0.9, ("amount", "12.50"): 0.6, ("phone", "+49 30 1234 5678"): 0.8,
    }


def test_near_duplicate_pages(spark, monkeypatch):
    from quillstack.operators import near

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", near.visible_text(F.col("html")).alias("text"))
    base = pages.orderBy(F.length("text").desc()).first()["text"]
    words = base.split()
    rng = random.Random(7)
    made = [(10_000 + k, " ".join(w if rng.random() > k / 3000 else "x" for w in words)) for k in range(40)] + [(10_100, base), (10_101, base.upper()), (10_102, None), (10_103, "  "), (10_104, "one"), (10_105, "ONE")]
    docs = pages.union(spark.createDataFrame(made, "page_id long, text string")).persist()

    def simhash(text):
        ws = (text or "").lower().split()
        runs = {" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)} if len(ws) >= 3 else {" ".join(ws)} - {""}
        return runs

    runs = {r["page_id"]: simhash(r["text"]) for r in docs.collect()}
    every = sorted(set().union(*runs.values()))
    codes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    value = {}
    for i, own in runs.items():
        if own:
            votes = [0] * 64
            for w in own:
                for b in range(64):
                    votes[b] += (codes[w] >> b) & 1
            value[i] = sum(1 << b for b in range(64) if 2 * votes[b] > len(own))
    assert {r["page_id"]: None if r["simhash"] is None else r["simhash"] % (1 << 64) for r in near.simhashes(docs, "page_id", "text").collect()} == {i: value.get(i) for i in runs}
    want = {}
    for i in runs:
        same = [j for j in value if i in value and value[j] == value[i]] or [i]
        links = [j for j in value if i in value and 0 < (value[i] ^ value[j]).bit_count() <= 3]
        want[i] = (min(same), len(same) - 1, len(links), min(same + links))
    assert sum(w[2] > 0 for w in want.values()) >= 10 and sum(w[1] > 0 for w in want.values()) >= 4
    for part in (near.PART, 3):
        monkeypatch.setattr(near, "PART", part)
        assert {r["page_id"]: tuple(r)[1:] for r in near.near_duplicates(docs, "page_id", "text").collect()} == want
    assert near.near_duplicates(docs.where("false"), "page_id", "text").count() == 0
