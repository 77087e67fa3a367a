import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import decontamination, mixing, ngram_join, queries, spotsigs, substring_dedup, suffix_tree

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return SPLIT.findall(text or "")


def test_substring_dedup(frame, awkward, few):
    window = 20
    found = {r["doc_id"]: r for r in substring_dedup.substring_dedup(frame(awkward), window).collect()}
    first = {}
    for i, t in sorted(awkward):
        w = split(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    for i, t in awkward:
        w = split(t)
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        r = found[i]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(gone), kept), i
        assert {p for s in r["spans"] for p in range(s["first"], s["after"])} == gone
    assert found[6]["kept"] == "" and found[5]["n_removed"] == 0 and found[15]["n_removed"] == 140


def test_substring_dedup_of_nothing_and_of_shared_ids(frame, few):
    assert substring_dedup.substring_dedup(frame([])).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    rows = substring_dedup.substring_dedup(frame([(1, text), (1, text), (None, text)]), carry=("source",)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 60), (1, 0), (1, 0)]
    assert "source" in rows[0]


def brute_tree(rows, trained, depth, least, keep, discount):
    end = b"\0"
    tokens = {i: [w.encode().lower() for w in split(t)] + [end] for i, t in rows}
    c = [Counter() for _ in range(depth + 2)]  # c[n]: n-grams
    for i in trained:
        for n in range(1, depth + 2):
            c[n].update(zip(*(tokens[i][k:] for k in range(n)), strict=False))
    n, v = sum(c[1].values()), len(c[1])
    root = lambda w: (c[1][w,] + 1) / (n + v + 1)
    states = {}
    for k in range(2, depth + 2):
        parts, kinds, held = defaultdict(float), Counter(), Counter()
        for g, x in c[k].items():
            s = g[:-1]
            if c[k - 1][s] >= least and x >= (keep if k > 2 else 1):
                suffix = root(g[-1]) if k == 2 else c[k - 1][g[1:]] / c[k - 2][s[1:]]
                parts[s] += x * math.log(x / c[k - 1][s] / suffix) - 0.5 * math.log(c[k - 1][s])
                kinds[s] += 1
                held[s] += x
        states |= {s: (kinds[s], held[s]) for s in parts if parts[s] >= 0}
    out = {}
    for i, t in tokens.items():
        base = score = 0.0
        length = 0
        for k, w in enumerate(t):
            p, longest = root(w), 0
            base += math.log10(p)
            for m in range(1, min(depth, k) + 1):
                s = tuple(t[k - m : k])
                if s in states:
                    kinds, held = states[s]
                    x, whole = c[m + 1][(*s, w)], c[m][s]
                    p = ((x - discount if x >= (keep if m > 1 else 1) else 0) + (whole - held + discount * kinds) * p) / whole
                    longest = m
            score += math.log10(p)
            length += longest
        out[i] = (len(t), sum(c[1][w,] > 0 for w in t), n, base, score, length / len(t))
    return out


@pytest.mark.parametrize(("learn", "depth", "keep", "relayed"), [(True, 3, 1, False), (True, 3, 2, True), (True, 1, 2, False), (True, 4, 3, True), (False, 3, 2, False)])
def test_suffix_tree(frame, awkward, learn, depth, keep, relayed):
    rows = [*awkward, (500, "One ONE one"), (501, awkward[4][1].upper()), (None, "one two"), (5, "one")]
    trained = [i for i, _ in rows if i is not None and i % 3] if learn else []
    docs = frame(rows)
    numbers = {(i, t): k for k, (i, t) in enumerate(rows)}
    docs = docs.withColumn("n", F.monotonically_increasing_id()).coalesce(2)
    few = {"chunk_bytes": 3000} | ({"direct": 2, "districts": 4} if relayed else {})
    got = suffix_tree.suffix_tree_scores(docs, (F.col("doc_id") % 3 != 0) & F.lit(learn), depth, least=4, keep=keep, **few)
    keyed = [(k, t) for (i, t), k in numbers.items()]
    want = brute_tree(keyed, [k for (i, _), k in numbers.items() if i in trained], depth, 4, keep, 0.7)
    found, expected = defaultdict(list), defaultdict(list)
    for r in got.collect():
        found[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 4), round(r["mean_context"], 5)))
    for (i, _), k in numbers.items():
        n, known, total, base, score, length = want[k]
        expected[i].append((n, known, total, round(base, 5), round(score, 4), round(length, 5)))
    for i in expected:
        for a, b in zip(sorted(found[i]), sorted(expected[i]), strict=True):
            assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-5, atol=2e-4), i
    assert set(found) == set(expected)
    if learn:
        assert found[6][0][4] > found[6][0][3] and found[501][0][4] == found[6][0][4]


def test_suffix_tree_of_texts_that_leave_repeated_contexts(frame, tmp_path):
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(words)) for i in range(300)] + [(i, " ".join(words[i % 3 :: 3])) for i in range(300, 330)]
    rows += [(i, " ".join(x for w in words[:-1] for x in (w, f"new{i}"))) for i in range(330, 350)]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op2_suffix_tree(frame(rows).sparkSession, str(tmp_path)).collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] >= 300]
    assert len(held) > 3 and min(r["score"] - r["base_score"] for r in found) >= -math.log10(4) - 1e-6
    assert all(r["score"] > r["base_score"] + 30 for r in found if r["doc_id"] < 300)


def test_suffix_tree_scores_are_finite_where_hashes_are_shared(monkeypatch):
    mix = suffix_tree.wh.mix
    monkeypatch.setattr(suffix_tree.wh, "mix", lambda x: mix(x) & np.uint64(0x3F << 58))
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(3)) for _ in range(30)).encode() for _ in range(60)] + [b"a0 a0 zz b1 b1 zz c2 c2 zz"] * 3
    state = suffix_tree.pa.table(suffix_tree.encode(0, list(range(len(texts))), texts, [i % 3 != 2 for i in range(len(texts))]))
    tree, got = suffix_tree.Tree(3, 4, 1, 0.7, 8, 0), None
    for n in range(1, 6):
        c = suffix_tree.Chunk(state, got, tree, n - 1)
        told = c.told([(1, c.keys[1], c.counts(1))]) if n == 1 else c.asks(n)
        told, answers = suffix_tree.pa.table(told), []
        for b in sorted(set(told["bucket"].to_pylist())):
            answers.append(suffix_tree.pa.table(suffix_tree._answer(told.filter(suffix_tree.pa.array([x == b for x in told["bucket"].to_pylist()])))))
        got = suffix_tree.pa.concat_tables([*([] if got is None else [got]), *answers], promote_options="permissive")
        if n == 1:
            tree = suffix_tree.replace(tree, tokens=sum(got["tokens"].to_pylist()), kinds=sum(got["kinds"].to_pylist()))
    values, _ = suffix_tree.Chunk(state, got, tree, 4).log_probabilities()
    assert np.isfinite(values).all() and (np.array(values) <= 0).all()


def test_suffix_tree_of_nothing(frame):
    assert suffix_tree.suffix_tree_scores(frame([]), F.lit(True)).count() == 0


def test_suffix_tree_messages_grow_with_the_corpus(spark, frame):
    """Four times the chunks and the buckets: about four times the rows, not sixteen, as relays stand between."""
    rng = random.Random(3)
    told = {}

    def hop_of(bits):
        schema = suffix_tree.arrow_schema(frame([]), suffix_tree.TOLD)
        return lambda t: suffix_tree.pa.table(suffix_tree._relay_asks(t, bits), schema=schema)

    for size in (1, 4):
        rows = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(300))) for k in range(24 * size)]
        docs = frame(rows, clash=False).coalesce(1)
        state = suffix_tree.states(docs, F.lit(True), "doc_id", "text", 4000).cache()
        count = state.count()
        for via in (0, 4):
            tree = suffix_tree.Tree(2, 4, 2, 0.7, 7 + (size == 4) * 2, via, 1)
            words = suffix_tree.tell_words(state, tree)
            groups = max(1, count >> (tree.bits - via))
            answers = suffix_tree.exchange(words, tree, groups)
            if via:
                relays = words.withColumn("relay", F.col("bucket").cast("long") * groups + F.pmod(F.xxhash64("chunk"), F.lit(groups)))
                hop = relays.groupBy("relay").applyInArrow(hop_of(tree.bits), suffix_tree.TOLD)
                told[size, via] = words.count() + hop.count()
            else:
                told[size, via] = words.count()
            assert answers.agg(F.sum("kinds")).first()[0] == len({w for _, t in rows for w in t.split()}) + 1
        state.unpersist()
    assert told[4, 0] > 8 * told[1, 0] and told[4, 4] < 5.5 * told[1, 4] and told[4, 4] < told[4, 0]


def chains(text):
    """A text's chains by plain steps; a text without one has itself."""
    words = re.sub(r"[^\w]+|_", " ", (text or "").lower()).split()
    known, out = set(spotsigs.anchors()), set()
    content = [k for k, w in enumerate(words) if w not in known or k == len(words) - 1]  # the last word joins nothing
    for one, two in zip(content, content[1:], strict=False):
        start = one
        while start and start - 1 not in content:
            start -= 1
        if start < one:
            out.add((tuple(words[start : one + 1]), words[two]))
    return out or ({tuple(words)} if words else set())


TEXTS = [
    (1, None), (2, ""), (4, "The cat of the house is in a red barn and the dog sleeps"), (7, "the cat of the house IS in a red barn and the dog sleeps"),
    (9, "!!"), (10, "word"), (30, "el perro de la casa está en un árbol y la luna brilla sobre el río"), (31, "the the the"), (90, "der Hund und die Katze im Haus der Frau mit dem Baum"),
]


def test_spotsigs(frame):
    found = {r["doc_id"]: r for r in spotsigs.edited_likeness(frame(TEXTS)).collect()}
    ids = [i for i, _ in TEXTS]
    text = {i: t or "" for i, t in TEXTS}
    measure = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, i in enumerate(ids):
        after = text[ids[(k + 1) % len(ids)]]
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + after[:half]
        r = found[i]
        assert (r["n_chars"], r["edited"]) == (len(text[i]), edited)
        a, b = (set(r[n]) for n in ("signatures", "edited_signatures"))
        assert len(a) == len(chains(text[i])) and len(b) == len(chains(edited))
        assert measure(a, b) == measure(chains(text[i]), chains(edited)) and r["near_next"] == measure(chains(text[i]), chains(after))
    assert found[4]["near_next"] == 1.0 and found[7]["class_id"] == 4 and found[9]["class_id"] == 1


def test_spotsigs_of_shared_ids_one_and_none(frame):
    assert spotsigs.edited_likeness(frame([])).count() == 0
    alone = spotsigs.edited_likeness(frame([(5, "abcd")])).collect()
    assert [(r["doc_id"], r["edited"]) for r in alone] == [(5, "abab")]
    twice = spotsigs.edited_likeness(frame([(5, "b"), (5, "a"), (6, "c")])).collect()
    assert sorted((r["doc_id"], r["edited"]) for r in twice) == [(5, "a"), (5, "b"), (6, "c")]
    every = spotsigs.edited_likeness(frame([(None, "zzzz"), (5, "b word"), (5, "a word"), (6, None), (None, "zzzz"), (1, "cccc")])).collect()
    assert sorted((r["doc_id"] or 99, r["edited"], r["class_id"] or 99) for r in every) == [(1, "cca ", 1), (5, "a wb w", 5), (5, "b w", 5), (6, "", 6), (99, "zzcc", 99), (99, "zzzz", 99)]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_spotsigs_near_copies(frame, awkward, words, monkeypatch, threshold):
    monkeypatch.setattr(spotsigs, "BLOCK", 8)
    rng = random.Random(13)
    rows = list(awkward)
    for family in range(3):
        base = [f"the {w}" for w in rng.choices(words, k=(8, 16, 60)[family])]
        for k in range(20):
            own = base[: len(base) - rng.randint(0, 4)]
            own[rng.randrange(len(own))] = f"the other{rng.randrange(9)}"
            rows.append((1000 + 7 * k + 200 * family, " ".join(own)))
    rows += [(2000 + k, "the " + " the ".join(rng.choices(words, k=rng.randint(2, 30)))) for k in range(800)]
    rows += [(1001, None), (None, rows[-1][1])]
    docs = frame(rows)
    prints = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", spotsigs.signatures(F.col("text")).alias("signatures")).cache()
    sets = {r["row"]: (r["doc_id"], frozenset(r["signatures"])) for r in prints.collect()}
    assert len(sets) > 900
    first = {}
    for i, v in sorted(sets.values(), key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(v, i)
    near = defaultdict(list)
    for a, i in first.items():
        for b, j in first.items():
            if a != b and a & b and len(a & b) >= threshold * len(a | b):
                near[a].append(j)
    want = {r: (first[v], len(near[v]), min(near[v], default=None)) for r, (_, v) in sets.items()}
    got = {r["row"]: (r["class_id"], r["n_links"], r["near_id"]) for r in spotsigs.near_copies(prints, threshold).collect()}
    assert got == want and (threshold == 1 or sum(n for _, n, _ in want.values()) > 60)


def test_spotsigs_common_signatures_bring_no_sets_together(frame, monkeypatch):
    written = []
    cut = spotsigs.cut
    monkeypatch.setattr(spotsigs, "cut", lambda df: written.append(cut(df)) or written[-1])
    rows = [(k, [1, 2, 3, *range(100 * k + 100, 100 * k + 110)]) for k in range(300)] + [(400, [1, 2, 3, *range(100, 109), 9])]
    prints = frame([]).sparkSession.createDataFrame([(k, k, v) for k, v in rows], "row long, doc_id long, signatures array<int>")
    found = {r["row"]: (r["n_links"], r["near_id"]) for r in spotsigs.near_copies(prints).collect()}
    assert {k: v for k, v in found.items() if v[0]} == {0: (1, 400), 400: (1, 0)}
    starts = next(df for df in written if "first" in df.columns)
    assert {r["c"] for r in starts.collect()} == {0, 400}


def shingles(text, n=5):
    w = split(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_groups(rows, threshold=0.8):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in sets}


def test_ngram_join(frame, awkward, words):
    rng = random.Random(8)
    base = rng.choices(words, k=200)
    chain = []
    for k in range(30):  # a drifting chain: neighbours are near, its ends are not; leaders alone would not do
        base = base[3:] + rng.choices(words, k=3)
        chain.append((1000 + k, " ".join(base)))
    rows = [*awkward, *chain]
    found = ngram_join.ngram_join(frame(rows))
    groups = {r["doc_id"]: r for r in found.groups.collect()}
    assert {i: r["group_id"] for i, r in groups.items()} == brute_groups(rows)
    assert groups[6]["class_id"] == 5 and groups[1]["class_id"] == 1 and groups[1]["n_links"] == 0 and groups[1029]["n_links"] > 0
    text = dict(rows)
    for r in found.links.collect():
        a, b = shingles(text[r["a"]]), shingles(text[r["b"]])
        assert math.isclose(r["jaccard"], len(a & b) / len(a | b)) and r["jaccard"] >= 0.8


def test_ngram_join_compares_what_leaders_leave(frame, words, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(9)
    base, rows = rng.choices(words, k=150), []
    for k in range(24):
        base = base[4:] + rng.choices(words, k=4)
        rows.append((k, " ".join(base)))
    assert {r["doc_id"]: r["group_id"] for r in ngram_join.ngram_join(frame(rows)).groups.collect()} == brute_groups(rows)


def test_ngram_join_links_all_pairs_of_a_family(frame, words, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "WIDTH", 128)
    rng = random.Random(10)
    rows = []
    for family, (least, most) in enumerate([(1, 1), (0, 3), (1, 1)]):  # near to each other throughout; only in part; in one block
        base = rng.choices(words, k=200)
        for k in range(6 if family == 2 else 24):
            own = list(base)
            for _ in range(rng.randint(least, most)):
                own[rng.randrange(200)] = f"edit{family}x{k}"
            rows.append((100 * family + k, " ".join(own)))
    rows += [(900, rows[0][1]), (901, "alone among all of them here")]
    found = ngram_join.ngram_join(frame(rows))
    sets = {i: shingles(t) for i, t in rows if i != 900}
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    # members without an edit are equal: the smallest stands for them
    classes = {r["doc_id"]: r["class_id"] for r in found.members.collect()}
    want = {p: v for p, v in like.items() if v >= 0.8 and all(classes[i] == i for i in p)}
    assert len(want) > 276 + 15
    got = {(r["a"], r["b"]): r["jaccard"] for r in found.links.collect()}
    assert set(got) == set(want) and all(math.isclose(got[p], want[p]) for p in want)
    groups = found.groups.collect()
    assert {r["doc_id"]: r["n_links"] for r in groups} == {r["doc_id"]: sum(r["class_id"] in p for p in want) for r in groups}


def test_ngram_join_of_nothing(frame):
    assert ngram_join.ngram_join(frame([])).groups.count() == 0
    assert [r["group_id"] for r in ngram_join.ngram_join(frame([(3, None)])).groups.collect()] == [3]


def test_ngram_join_of_odd_ids(spark, frame, words):
    """Repeated ids of unequal texts, null ids and ids that are no numbers: each row counts for itself."""
    rng = random.Random(14)
    make = lambda n: " ".join(rng.choices(words, k=n))
    base = make(200)
    near = base.replace(base.split()[50], "edited", 1)
    rows = [(1, base), (1, make(90)), (2, near), (None, base), (None, make(40)), (3, None), (1, base)]
    found = Counter(tuple(r) for r in ngram_join.row_groups(frame(rows)).collect())
    assert found == Counter({(1, 1, 1, 1): 2, (1, 1, 1, 0): 1, (2, 2, 1, 1): 1, (None, 1, 1, 1): 1, (None, None, None, 0): 1, (3, 3, 3, 0): 1})
    named = spark.createDataFrame([("x", base), ("b", near), ("a", "other words here")], "doc_id string, text string")
    assert sorted(tuple(r) for r in ngram_join.row_groups(named).collect()) == [("a", "a", "a", 0), ("b", "b", "b", 1), ("x", "x", "b", 1)]
    assert ngram_join.row_groups(frame([])).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9995), (0.8, 0.9), (0.5, 0.9)):
        bands, rows = ngram_join.bands_for(threshold, recall)
        assert bands * rows <= 160 and 1 - (1 - threshold**rows) ** bands >= recall


def filled(sizes, weights, share, most):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, open_, target = set(), set(sizes), {}
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] if s in full else left * weight[s] / total for s in sizes}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over
        open_ -= over


def mix_rows(words):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 900))), "en", rng.choice(["a", "a", "a", "b", "c", None, ""]), 0) for i in range(120)]
    return rows + [(200, None, "en", "empty", 0), (201, "", "en", None, 0), (201, "", "en", None, 0), (202, "x y", "en", "tiny", 0), (None, "p q r", "en", "a", 0), (5, "again", "en", "b", 0)]


def test_mixing(spark, words):
    rows = mix_rows(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(0) for c in ("rank", "size", "block", "start", "key")})
    found = mixing.mix(docs)
    out = [tuple(r) for r in found.docs.collect()]
    assert len(out) == len(rows) and sorted(map(repr, out)) == sorted(map(repr, (tuple(r) for r in mixing.mix(docs.repartition(3)).docs.collect())))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(split(t))
    want = filled(sizes, (5, 2, 1), 1.5, 2.0)
    plan = {r["source"]: r for r in found.sources.collect()}
    assert all(math.isclose(plan[s]["target"], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)
    assert all(t <= 2 * n for _, n, _, _, t in out)
    by_size = defaultdict(int)
    for _, _, source_size, target, taken in out:
        by_size[source_size, target] += taken
    for (n, target), taken in by_size.items():
        assert abs(taken - target) <= 256, (n, target, taken)
    quota = {r["rank"]: r["slots"] for r in plan.values() if r["slots"]}
    total, line = sum(quota.values()), [k for k in sorted(quota) for _ in range(quota[k])]
    draws, left = [Counter() for _ in range(64)], Counter(quota)
    for k in range(total):  # each place draws; beyond its quota a source gets nothing, and the last shard takes what is missing
        rank = line[int(hashlib.md5(f"20|draw|{k}".encode()).hexdigest()[:12], 16) % total]
        if left[rank]:
            draws[k // -(-total // 64)][rank] += 1
            left[rank] -= 1
    draws[63].update({k: n for k, n in left.items() if n})
    assert {(r["shard"], r["rank"]): r["n"] for r in found.counts.collect()} == {(k, x): n for k, c in enumerate(draws) for x, n in c.items()}
    shards = Counter((r["shard"], r["rank"]) for r in found.slots.where("words is null").collect())
    assert shards == {(k, x): n for k, c in enumerate(draws) for x, n in c.items()}
    blocks = {(r["rank"], r["epoch"]): set() for r in found.slots.collect()}
    for r in found.slots.collect():  # a permutation gives no index twice
        assert r["block"] not in blocks[r["rank"], r["epoch"]]
        blocks[r["rank"], r["epoch"]].add(r["block"])
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})  # noqa: F841  DuckDB reads it by name
    con.register("documents", documents)
    theirs = con.sql(queries.OP7_SQL).fetchall()
    plain = lambda rows: sorted((-1 if r[0] is None or r[0] != r[0] else int(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in rows)
    assert plain(out) == plain(theirs)


def test_mixing_nothing(frame):
    assert mixing.mix(frame([])).docs.count() == 0
    assert [(r["size"], r["taken"]) for r in mixing.mix(frame([(1, None)])).docs.collect()] == [(0, 0)]


def brute_tiles(a, b, least):
    """Greedy string tiling by trying every pair of places."""
    left, right, tiles = set(range(len(a))), set(range(len(b))), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n in left and j + n in right and a[i + n] == b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        tiles.append(best)
        left -= set(range(best[0], best[0] + best[2]))
        right -= set(range(best[1], best[1] + best[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=14), st.integers(1, 4))
def test_tiling(a, b, least):
    x, y = (np.array(v, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for v in (a, b))
    want = brute_tiles(a, b, least)
    assert decontamination.tile(x, y, least) == want and decontamination.tile_lengths(x, y, least) == want


def test_tiling_of_very_repetitive_texts():
    x = np.full(40_000, 7, np.uint64)
    assert decontamination.tile(x, x[:3000], 5) == [(0, 0, 3000)]  # 10**8 pairs of places
    seeds = decontamination.Seeds([1, 2], [b"ab " * 3000, b"cd " * 30], 5)
    words, _ = decontamination.hash_tokens([b"ab " * 40_000])
    assert [(k, t) for k, t in seeds.found(words, 0.5)] == [(0, [(0, 0, 3000)])]


def test_decontaminate(spark, frame, words, awkward):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choices(words, k=rng.randint(20, 60)))) for k in range(12)] + [(50, None), (51, ""), (52, "two words"), (53, awkward[7][1][:120])]
    make = lambda n: " ".join(rng.choices(words, k=n))
    one, two = items[0][1].split(), items[1][1].split()
    half = len(one) // 2
    rows = [*awkward, (300, make(50) + " " + items[0][1] + " " + make(9)), (301, " ".join(one[half:]) + " " + make(30) + " " + " ".join(one[:half])), (302, items[2][1].upper().replace(" ", ", "))]
    rows += [(303, " ".join(two[: len(two) // 3])), (304, items[3][1] + " " + items[4][1]), (305, items[5][1]), (305, items[5][1])]
    rows += [(None, items[6][1]), (None, items[6][1] + " more"), (306, items[7][1])]
    items += [(None, items[7][1]), (None, items[8][1]), (8, items[8][1]), (8, " ".join(["same words again and again"] * 30))]
    rows += [(307, "same words again and again " * 40), (308, items[8][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(0))
    tokens = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for i, t in rows:
        for x, b in items:
            w = tokens(b)
            got = sum(n for _, _, n in brute_tiles(tokens(t), w, 5)) if len(w) >= 5 and set(zip(*(w[k:] for k in range(5)), strict=False)) & set(zip(*(tokens(t)[k:] for k in range(5)), strict=False)) else 0
            if w and got >= 0.5 * len(w) and got:
                want.append((i, x, got))
    key = lambda w: tuple((v is None, v or 0) for v in w)
    for limit in (decontamination.BROADCAST_TOKENS, 0):
        found = decontamination.decontaminate(frame(rows), bench, broadcast_tokens=limit).collect()
        assert sorted(((r["doc_id"], r["item_id"], r["n_matched"]) for r in found), key=key) == sorted(want, key=key)
    assert {(None, 6), (306, None), (306, 7), (307, 8), (308, None)} <= {w[:2] for w in want}
    assert {(300, 0), (301, 0), (302, 2), (304, 3), (304, 4)} <= {w[:2] for w in want} and 303 not in {w[0] for w in want}
    assert decontamination.decontaminate(frame([]), bench).count() == 0
    assert decontamination.decontaminate(frame(rows), bench.where("false")).count() == 0


