"""Duplicate checks, inconsistencies, risk scores and the gate before the workflow."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp


def duplicate_groups(docs: DataFrame, checksum: str, key: str) -> DataFrame:
    """Checksums that several documents have, with their number and smallest id."""
    return docs.groupBy(checksum).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")


def duplicate_flags(docs: DataFrame, checksum: str, key: str) -> DataFrame:
    """key, is_duplicate, is_first. A count for each checksum is made before the shuffle and joined back; a join's hot key can be split, a window's can't."""
    groups = docs.groupBy(checksum).agg(F.count("*").alias("__n"), F.min(key).alias("__first"))
    return docs.join(groups, checksum).select(key, (F.col("__n") > 1).alias("is_duplicate"), (F.col(key) == F.col("__first")).alias("is_first"))


#: Words of a passage that are looked for, characters of a very short one, and bytes of passages up to which they are broadcast.
WINDOW, GRAM, PASSAGE_BYTES = 5, 4, 64 << 20


def known_passages(docs: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str) -> DataFrame:
    """key, item: the documents that contain a passage, character for character.

    The words of a passage but its first and last are whole words of whatever
    contains it: the first WINDOW of them make the candidates, or of shorter passages the longest one. One or two words may be
    parts of longer ones; the first GRAM characters of the longer word are then in some word of whatever contains them.
    Only keys go with words; a text is fetched where all that has met. Passages without even such a word are looked for in every
    text, each different one once. Null and empty passages are in none.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    window = lambda ws, k: F.xxhash64(*(F.get(ws, k + i) for i in range(WINDOW)))
    once = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  computed once, however often f uses it
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    grams = lambda w: F.when(F.length(w) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(w) - GRAM + 1), lambda k: F.substring(w, k, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))

    known = passages.select(F.col(item).alias("__item"), F.col(passage).alias("__passage")).where(F.length("__passage") > 0).withColumn("__words", words(F.col("__passage")))
    n, most = F.size("__words"), longest(F.col("__words"))
    # a passage that begins or ends at a white space has whole words there; leaving them out does no harm
    kind = F.when(n >= WINDOW + 2, "window").when(n >= 3, "word").when(most["n"] >= GRAM, "gram").otherwise("tiny")
    inner = longest(F.slice("__words", 2, F.greatest(n - 2, F.lit(1))))["w"]
    sign = F.when(kind == "window", window(F.col("__words"), F.lit(1))).when(kind == "word", F.xxhash64(inner)).when(kind == "gram", F.xxhash64(F.substring(most["w"], 1, GRAM)))
    known = known.select("__item", "__passage", kind.alias("__kind"), sign.alias("__sign"))
    there = {r["__kind"]: r["bytes"] for r in known.groupBy("__kind").agg(F.sum(F.octet_length("__passage")).alias("bytes")).collect()}  # four kinds
    deal = F.broadcast if sum(there.values()) <= PASSAGE_BYTES else lambda df: df

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    signs = {
        "window": once(words(F.col("__text")), lambda ws: F.transform(ws, lambda w, k: window(ws, k))),
        "word": F.transform(F.array_distinct(words(F.col("__text"))), lambda w: F.xxhash64(w)),
        "gram": F.transform(F.array_distinct(F.flatten(F.transform(F.array_distinct(words(F.col("__text"))), grams))), lambda g: F.xxhash64(g)),
    }
    found = rows.join(known, F.lit(False)).select("__key", "__item")
    met = [rows.select("__key", F.explode(sign).alias("__sign")).join(deal(known.where(F.col("__kind") == k).select("__sign", "__item")), "__sign").select("__key", "__item") for k, sign in signs.items() if k in there]
    if met:
        candidates = functools.reduce(DataFrame.union, met).distinct()
        full = candidates.join(deal(known.select("__item", "__passage")), "__item").join(rows, "__key")
        found = full.where(F.contains("__text", F.col("__passage"))).select("__key", "__item")
    if "tiny" in there:
        tiny = known.where("__kind = 'tiny'").groupBy("__passage").agg(F.collect_set("__item").alias("__items"))
        found = found.union(rows.join(deal(tiny), F.contains(F.col("__text"), F.col("__passage"))).select("__key", F.explode("__items")))
    return found.select(F.col("__key").alias(key), F.col("__item").alias(item))


def metadata_mismatch(children: DataFrame, docs: DataFrame, key: str, child_when: str, when: str) -> DataFrame:
    """Children dated before their document."""
    return children.join(docs.select(key, when), key).where(F.col(child_when) < F.col(when))


def risk(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """risk_score, clamped to 0 to 1, and details: which checks fired, as JSON. checks: name -> (fired, weight)."""
    score = sum((F.when(fired, weight).otherwise(0.0) for fired, weight in checks.values()), F.lit(0.0))
    details = F.to_json(F.struct(*(F.coalesce(fired, F.lit(False)).alias(name) for name, (fired, _) in checks.items())))
    return df.withColumns({"risk_score": clamp(score), "details": details})


def gate(df: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """(what may go on, what is quarantined)."""
    return df.where(F.col("risk_score") < limit), df.where(F.col("risk_score") >= limit)
