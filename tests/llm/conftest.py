import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that nothing may stumble over.
CLASHING = ("id", "chunk", "bucket", "rank", "size", "key", "c0", "a", "b", "n", "score", "signatures", "kept", "__text")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]


@pytest.fixture(scope="session")
def awkward(words):
    """(doc_id, text) with nulls, empty and long texts, copies, near copies, shared passages and white space of all kinds."""
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choices(words, k=n))
    passage, base, long = make(70), make(300), make(4000)
    near = base.split()
    near[40] = "changed"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, base), (6, base), (7, " ".join(near)), (8, make(30) + " " + passage + "\n" + make(20))]
    rows += [(9, passage.replace(" ", "\t\x0b ")), (10, make(100) + " " + passage), (11, long), (12, long[: len(long) // 2] + " " + make(10)), (13, "ä ö " + make(60)), (14, "one"), (15, passage + " " + passage)]
    rows += [(20 + k, base if k % 2 else " ".join(near[k:])) for k in range(6)]
    rows += [(100 + k, make(rng.randint(1, 120))) for k in range(40)]
    return rows


@pytest.fixture()
def frame(spark):
    """(doc_id, text) rows as documents with clashing columns."""
    from pyspark.sql import functions as F

    def make(rows, clash=True):
        langs, sources = ["en", "de", None], ["s0", "s0", "s1", None, ""]
        full = [(i, t, langs[k % 3], sources[k % 5], len(t) if t else 0) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, COLUMNS)
        return df.withColumns({c: F.lit(c) for c in CLASHING}) if clash else df

    return make


@pytest.fixture()
def few(monkeypatch):
    """Few chunks, to keep the tests short."""
    import functools

    from quillstack.llm import chunks, substring_dedup

    for module in (substring_dedup,):
        monkeypatch.setattr(module, "Chunks", lambda *a, **k: functools.partial(chunks.Chunks)(*a, **(k | {"least": 3})))
