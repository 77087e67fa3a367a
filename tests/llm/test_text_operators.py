import random
import re
from itertools import pairwise

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import common, language_id, license_scan, token_counts, toxicity, wordhash


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \t\n é", max_size=30)), max_size=8))
def test_words_are_split_and_hashed(texts):
    raw = [None if t is None else t.encode() for t in texts]
    hashes, offsets = wordhash.hash_words(raw)
    split = [re.findall(rb"[^\x20\x09-\x0D]+", t or b"") for t in raw]
    assert np.diff(offsets).tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert len({(w, h) for w, h in zip(flat, hashes.tolist(), strict=True)}) == len(set(flat))


def test_long_texts_hash_in_parts(monkeypatch):
    text = b" ".join(b"w%d" % (k % 97) for k in range(5000))
    whole, _ = wordhash.hash_words([text])
    monkeypatch.setattr(wordhash, "PIECE", 1000)
    parts, offsets = wordhash.hash_words([b"x y", text, b"", text])
    assert offsets.tolist() == [0, 2, 5002, 5002, 10002]
    assert (parts[2:5002] == whole).all() and (parts[5002:] == whole).all()
    runs = wordhash.runs(whole, 97)
    assert (runs[:97] == runs[97:194]).all() and len(set(runs[:97].tolist())) == 97


VOCABULARY = st.lists(st.text("abc", min_size=1, max_size=4), max_size=12)


@settings(max_examples=300, deadline=None)
@given(VOCABULARY, VOCABULARY, st.text("abcd", max_size=12))
def test_automaton_is_greedy(inner, final, word):
    vocabulary = [tuple(w.encode()) for w in inner] + [(*w.encode(), 256) for w in final]
    a, words = token_counts.Automaton(vocabulary), [word.encode()[k:] for k in range(len(word) + 1)]
    want = [token_counts.greedy_count(w, set(vocabulary)) for w in words]
    assert [a.count(w) for w in words] == want
    ends = np.cumsum([len(w) for w in words])
    assert a.counts(np.frombuffer(b"".join(words) or b"x", np.uint8), ends - [len(w) for w in words], ends).tolist() == want


SPLIT = re.compile(rb"[0-9]+|[A-Za-z\x80-\xff]+|[^\x00-\x20A-Za-z0-9\x7f-\xff]+")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30))
def test_pretokens(text):
    starts, ends = token_counts.pretokens(text)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == SPLIT.findall(text)


def test_token_counts(frame, awkward):
    awkward = [*awkward, (900, "ab12 !!ab é-ab\x7fab " * 3), (901, ("abh 7 " * 400_000))]
    vocabulary = [(b,) for b in b"abcdefgh"] + [tuple(b"ab"), (*b"ab", 256), (*b"h", 256)]
    known = set(vocabulary)
    found = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in token_counts.token_counts(frame(awkward), vocabulary).collect()}
    for i, t in awkward:
        parts = SPLIT.findall((t or "").encode().lower())
        assert found[i] == (len(parts), sum(token_counts.greedy_count(p, known) for p in parts))
    assert token_counts.token_counts(frame([]), vocabulary).count() == 0


LICENSES = [
    (1, "Released under the MIT License."), (2, "released under the terms of the MIT license, and the Apache License"), (3, None), (4, ""),
    (5, "This work is licensed under the GNU General Public License, version 3."), (6, "general public licenses are not it"),
    (7, "Licensed under CC BY-NC 4.0."), (8, "MIT-license mit LICENSE MIT License"), (9, "Redistribution and use in source and binary forms, without modification"),
]


def test_license_scan(frame):
    rows = {r["doc_id"]: r for r in license_scan.license_scan(frame(LICENSES)).collect()}
    for i, t in LICENSES:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert rows[1]["labels"] == "mit,mit-name" and rows[2]["labels"] == "apache,mit,mit-name"
    assert rows[5]["labels"] == "gpl,gpl-3.0" and rows[7]["labels"] == "cc-by-nc" and rows[7]["base_labels"] == ""
    assert rows[9]["labels"] == "" and rows[9]["score"] == 0.0 and rows[8]["n_base"] == 3


def test_template_markup():
    a = license_scan.TokenAutomaton({"t": ("start <<opt>>maybe so<<end>> middle <<var:2>> end",)})
    places = lambda t: a.matches(t.encode().split())
    assert places("x start middle end") == [(1, 4, "t")]
    assert places("start maybe so middle one two end") == [(0, 7, "t")]
    assert places("start maybe middle end") == [] and places("start middle one two three end") == []


def ends(parts, words, i):
    """Places where a template's parts can end, from place i on, by trying everything."""
    if not parts:
        return {i}
    kind, value = parts[0]
    if kind == "opt":
        return ends(value + parts[1:], words, i) | ends(parts[1:], words, i)
    if kind == "var":
        return set().union(*(ends(parts[1:], words, i + n) for n in range(value + 1) if i + n <= len(words)))
    return ends(parts[1:], words, i + 1) if i < len(words) and words[i] == value else set()


def parsed(template):
    stack = [[]]
    for w in re.findall(r"<<[^>]*>>|[^\s<>]+", template):
        if w == "<<opt>>":
            stack.append([])
        elif w == "<<end>>":
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif w.startswith("<<var:"):
            stack[-1].append(("var", int(w[6:-2])))
        else:
            stack[-1].append(("word", w))
    return stack[0]


TEMPLATES = [("p", ("a <<opt>>b <<opt>>c<<end>><<end>> a", "c <<var:2>> b")), ("q", ("a <<var:1>> c a",)), ("r", ("<<opt>>b<<end>> a b",))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14))
def test_automaton_accepts_as_by_trial(words):
    every = {(i, j, x) for x, forms in TEMPLATES for f in forms for i in range(len(words)) for j in ends(parsed(f), words, i) if j > i}
    want = sorted(s for s in every if not any(o[0] <= s[0] and s[1] <= o[1] and o[:2] != s[:2] for o in every))
    assert license_scan.TokenAutomaton(dict(TEMPLATES)).matches([w.encode() for w in words]) == want


WORDINGS = [
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"), ("a Creative Commons text, under the Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"),
    ("licensed under CC BY 4.0", "cc-by"), ("under the terms of the GNU Lesser General Public License v2.1 or later", "gpl,lgpl-2.1-or-later"),
    ("under the GNU Affero General Public License, version 3", "agpl-3.0,gpl"), ("released under the 3-clause BSD license", "bsd-name"),
    (" ".join(license_scan.TEMPLATES["mit-text"]).replace("<<var:10>>", "this software and its files").replace("<<opt>>", "").replace("<<end>>", ""), "mit-text"),
    ("the general public license may be read under a tree", "gpl"),
]


def test_license_templates_of_several_lines(frame):
    templates = {"own": ("alpha beta <<opt>>a very\nlongwordinside line\nor two<<end>> gamma",), "nested": ("delta <<opt>>one <<opt>>twentytwo<<end>>\nthree<<end>> epsilon",)}
    docs = frame([(1, "alpha beta gamma"), (2, "alpha beta a very longwordinside line or two gamma"), (3, "alpha gamma"), (4, "delta epsilon"), (5, None)])
    found = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(docs, templates=templates).collect()}
    assert found == {1: "own", 2: "own", 3: "", 4: "nested", 5: ""}
    assert license_scan.mandatory(templates["nested"][0]).split() == ["delta", "epsilon"]
    # no mandatory word: any text may hold it, and those that do are looked at
    free = license_scan.license_scan(docs, templates={"free": ("<<opt>>alpha<<end>> <<opt>>beta<<end>>",)})
    assert {r["doc_id"]: r["n_words"] for r in free.collect()} == {1: 3, 2: 9, 3: 2, 4: 2, 5: 0}


def test_license_wordings(frame):
    found = {r["doc_id"]: r for r in license_scan.license_scan(frame(list(enumerate(t for t, _ in WORDINGS)))).collect()}
    for k, (text, labels) in enumerate(WORDINGS):
        assert found[k]["labels"] == labels, text
    everything = [" ".join(re.sub(r"<<var:\d+>>", "some name", re.sub(r"<<opt>>|<<end>>", " ", f)).split()) for forms in license_scan.TEMPLATES.values() for f in forms]
    got = license_scan.license_scan(frame(list(enumerate(everything)))).where("score < 1").count()
    assert got == 0  # each template accepts its own wording, with all that is optional
    assert license_scan.license_scan(frame([])).count() == 0


def test_toxicity(spark, frame, words):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = rng.choices(words, k=rng.randint(5, 60))
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["zzslur", "zzslured", "zzslуr", "zzsIur5".lower().replace("5", ""), "ZZSLUR"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = common.fold_of("doc_id", 5) == 0
    docs = frame([*rows, (1000, None), (1001, ""), (1002, rows[0][1]), (1003, rows[0][1])])
    model = toxicity.fit(docs, labelled.where(~held))
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    wrong = [i for i, y in labels if found[i]["predicted"] != y]
    assert len(wrong) <= 12, wrong
    assert found[1000]["predicted"] == found[1001]["predicted"] == 0 and found[1002]["score"] == found[1003]["score"] == found[0]["score"]
    nothing = toxicity.fit(docs, labelled.where("toxic = 9"))
    assert {r["score"] for r in toxicity.toxicity(docs, nothing).collect()} == {0.0}
    assert toxicity.toxicity(frame([]), model).count() == 0


def test_toxicity_weights_and_features(spark, frame, words):
    """Every term's weight, both features of every text and the curve's optimum, recomputed plainly."""
    rng = random.Random(4)
    slurs = ["badword", "badwords", "uglyname", "meanie" * 9]
    rows = [(i, " ".join(rng.choices(words, k=20) + rng.choices(slurs, k=2) * (i % 3 == 0) + ["badword"] * (i % 40 == 1))) for i in range(240)]
    rows += [(300, None), (301, rows[0][1])]
    labels = {i: int(i % 3 == 0) for i, _ in rows}
    docs = frame(rows)
    model = toxicity.fit(docs, spark.createDataFrame([*labels.items(), (7777, 1), (5, None)], "doc_id long, toxic int"))
    found = {i: {f"{w} " for w in (t or "").lower().split()} | {w[:n] for w in (t or "").lower().split() for n in range(4, 8) if len(w) > n} for i, t in rows}
    toxic, clean = ([i for i in labels if labels[i] == y] for y in (1, 0))
    want, candidates = {}, 0
    for t in set().union(*found.values()):
        a, b = (sum(t in found[i] for i in ids) for ids in (toxic, clean))
        if a >= 6:
            candidates += 1
            w = np.log((a + 0.5) / (len(toxic) + 1)) - np.log((b + 0.5) / (len(clean) + 1))
            want[t] = (w, w / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    want = {t: w for t, (w, z) in want.items() if w >= 2 and z >= max(3, np.sqrt(2 * np.log(candidates)))}
    assert set(model.weights) == set(want) >= {"badword ", "uglyname ", slurs[3] + " "}
    assert all(abs(model.weights[t] - want[t]) < 1e-9 for t in want)

    def features(text):
        ws = (text or "").lower().split()
        total = sum(max([0.0, *(w for t, w in want.items() if (x + " ").startswith(t))]) for x in ws)
        return np.log1p(total), np.log1p(100 * total / max(1, len(ws)))

    x, y = np.array([features(t) for _, t in rows]), np.array([labels[i] for i, _ in rows])
    m = model.ready()
    assert np.allclose([m.features(toxicity.fold(t or "")) for _, t in rows], x, atol=1e-9)
    p = 1 / (1 + np.exp(-(model.curve[0] + x @ np.array(model.curve[1:]))))
    slope = np.array([(p - y).sum() + 1e-3 * model.curve[0], *(x.T @ (p - y) + np.array(model.curve[1:]))])
    assert np.abs(slope).max() < 1e-4
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    assert all(abs(scores[i] - v) < 1e-9 for (i, _), v in zip(rows, p, strict=True))


def test_folding_and_exceptions():
    assert toxicity.fold("Scуm, 1d10t! m0r0n 21.178 $$$ Ｔrash") == " scym idiot moron 21 178 trash "
    m = toxicity.Model({"trash ": 2.0, "scum": 3.0}).ready()
    total = lambda t: round(float(np.expm1(m.features(toxicity.fold(t))[0])), 6)
    assert total("trash") == 2.0 and total("the trash can") == 0.0 and total("trashy") == 0.0 and total("scumbag trash") == 5.0


def test_language_id(frame, spark):
    rng = random.Random(2)
    kinds = {"xx": "abcde", "yy": "mnopq", "zz": "vwxyz"}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(kinds))
        rows.append((i, " ".join("".join(rng.choices(kinds[lang], k=5)) for _ in range(rng.randint(3, 40))), lang, "s", 0))
    rows += [(900, None, "xx", "s", 0), (901, "", "xx", "s", 0), (902, "12 34 !", "yy", "s", 0), (903, rows[0][1], None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    held = common.fold_of("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held), per_lang=60)
    found = {r["doc_id"]: r for r in language_id.language_id(docs, model).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang, _, _ in rows[:300])
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] for i in (900, 901, 902))
    assert found[903]["lang_pred"] == rows[0][2] and 0 <= found[903]["score"] <= 1
    empty = language_id.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.language_id(docs, empty).collect()} == {"und"}


def brute_logits(m, text):
    """Forward pass over a text's runs, one by one."""
    flat = " ".join(re.sub(rb"[^a-z\x80-\xff]", b" ", re.sub(rb"[A-Z]", lambda x: x[0].lower(), text)).decode("latin-1").split())
    flat = f" {flat} ".encode("latin-1")
    total = np.zeros(len(m.langs))
    for k in range(len(flat)):
        for n in (3, 4):
            run = int.from_bytes((flat + b"   ")[k : k + n], "little") + (n == 4)
            total += m.table[(run * 2654435761) % (1 << 32) >> 17] / language_id.SCALE
    return total / (2 * len(flat)) + m.bias


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("aB éz.7 ", max_size=40), min_size=1, max_size=8), st.integers(0, 3))
def test_logits_are_a_texts_own(texts, long):
    rng = np.random.default_rng(0)
    m = language_id.Model(["a", "b"], rng.integers(-1 << 20, 1 << 20, (language_id.BUCKETS, 2)).astype(np.int32), np.array([0.25, -1.0]), 1.0, 0.0)
    raw = [t.encode() for t in texts] + [b"some words " * 7000] * (long == 0)  # the last is over a part's size
    beside = m.logits(raw)
    for k, t in enumerate(raw):
        assert (m.logits([t])[0] == beside[k]).all() and (m.logits([b"x", t, b"other"])[1] == beside[k]).all()
        if len(t) < 1000:
            assert np.allclose(beside[k], brute_logits(m, t), rtol=0, atol=1e-9)


def test_long_text_has_the_mean_of_its_grams():
    rng = np.random.default_rng(0)
    m = language_id.Model(["a", "b"], rng.integers(-1 << 20, 1 << 20, (language_id.BUCKETS, 2)).astype(np.int32), np.zeros(2), 1.0, 0.0)
    text = b"some words " * 7000
    b, c = language_id.features(text)
    want = (m.table[b].astype(float) * np.array(c)[:, None]).sum(axis=0) / sum(c) / language_id.SCALE
    assert np.allclose(m.logits([b"", text, b"x"])[1], want, rtol=0, atol=1e-9)
    assert all(a <= b for a, b in pairwise(b))


def test_training_follows_the_gradient():
    """One step of the descent against the loss' slope, by small differences."""
    rng = np.random.default_rng(3)
    rows = [(x, *language_id.features(t)) for x, t in (("aa", b"some words of one kind"), ("bb", b"ein paar andere")) for _ in range(12)]
    m = language_id.train(rows, epochs=8)
    loss = lambda bias, table: -sum(np.log(language_id.Model(m.langs, table, bias, 1.0, 0.0).scores(language_id.Model(m.langs, table, bias, 1.0, 0.0).logits([t]))[0, k]) for k, t in enumerate((b"some words of one kind", b"ein paar andere")))
    assert loss(m.bias, m.table) < 0.2 < loss(m.bias, m.table * 0) and loss(m.bias, m.table) < loss(m.bias, rng.permutation(m.table))
