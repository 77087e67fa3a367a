"""Field extraction by rules, its confidence, and human review."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of fields. A group leaves out the character before; what follows is a longer run's own, so that a rule looks at whole runs.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = r"(?:^|[^0-9A-Za-z])([0-9]{13,})"
ADDRESS = r"(?:^|[^0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3,})"
SECRET = r"(?:token|secret|password|key) *[=:] *\"?([0-9a-fA-F]{16,})"
AMOUNT = r"(?:^|[^0-9.,])([0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2})(?:[^0-9.]|$)"
DATE = r"(?:^|[^0-9-])([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[^0-9-]|$)"
PHONE = r"(\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){2,5})"


@dataclass(frozen=True)
class Rule:
    """A field's name, its pattern, the confidence of a value (a function of the value's column), which values are kept (all, without one), and a character that every match has, without which a text is not searched."""

    name: str
    pattern: str
    confidence: Callable[[Column], Column]
    group: int = 0
    keep: Callable[[Column], Column] | None = None
    has: str | None = None


def email_confidence(value: Column) -> Column:
    return F.when(F.lower(value).endswith(".com"), 0.9).otherwise(0.7)


def luhn(value: Column) -> Column:
    """Whether a number's last digit is the check digit of those before: every second digit from the right but one counts twice."""
    digit = lambda i: F.substring(value, F.length(value) - i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 9, x - 9).otherwise(x)
    total = F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, digit(i)).otherwise(twice(2 * digit(i))))
    return total % 10 == 0


def _parts(value: Column) -> Column:
    return F.split(value, r"\.")


RULES = (Rule("email", EMAIL, email_confidence, has="@"),)
#: All rules; a value's own check digit, range or form decides on its confidence.
FIELD_RULES = (
    *RULES,
    Rule("card", CARD, lambda v: F.when(luhn(v), 0.95).otherwise(0.4), 1, lambda v: F.length(v) == 16),
    Rule("address", ADDRESS, lambda v: F.when(F.forall(_parts(v), lambda x: x.cast("int") <= 255), 0.9).otherwise(0.2), 1, lambda v: F.size(_parts(v)) == 4, "."),
    Rule("secret", SECRET, lambda v: F.when(F.length(v).isin(32, 40, 64), 0.95).otherwise(0.6), 1),
    Rule("amount", AMOUNT, lambda v: F.when(F.contains(v, F.lit(",")), 0.9).otherwise(0.6), 1, has="."),
    Rule("date", DATE, lambda v: F.when(F.try_to_date(v, "yyyy-MM-dd").isNotNull(), 0.95).otherwise(0.1), 1, has="-"),
    Rule("phone", PHONE, lambda v: F.lit(0.8), 1, has="+"),
)


def extract_fields(docs: DataFrame, key: str | list[str], text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key (one column or several), field_name, field_value, confidence_score: one row for each match of each rule. The text is read once."""

    def values(r: Rule) -> Column:
        matches = F.regexp_extract_all(F.col(text), F.lit(r.pattern), F.lit(r.group))
        if r.has is not None:
            matches = F.when(F.contains(F.col(text), F.lit(r.has)), matches).otherwise(F.array().cast("array<string>"))
        kept = matches if r.keep is None else F.filter(matches, r.keep)
        return F.transform(kept, lambda v: F.struct(F.lit(r.name).alias("field_name"), v.alias("field_value"), r.confidence(v).cast("double").alias("confidence_score")))

    keys = [key] if isinstance(key, str) else key
    # a one-element array: of inline() itself the optimizer makes filters too, in which all is searched again
    found = docs.select(*keys, F.explode(F.array(F.concat(*map(values, rules)))).alias("__found"))
    return found.select(*keys, F.inline("__found"))


def pool(points: Column) -> Column:
    """Isotonic means of an array of (at, n, good) in the order of `at`: an array of (at, confidence).

    Pool-adjacent-violators: points are taken in turn as blocks; a block whose mean is not
    over that of the one before is joined with it, and so on down. Means are compared as
    products of whole numbers, so that nothing is rounded.
    """
    block = "struct<ats:array<bigint>,n:bigint,good:bigint>"

    def joined(blocks: Column, new: Column) -> Column:
        # from the last block back: what the new one swallows, and what stays
        state = F.struct(F.array().cast(f"array<{block}>").alias("kept"), new.cast(block).alias("top"))

        def step(s: Column, b: Column) -> Column:
            violates = F.size(s["kept"]) == 0
            violates = violates & (b["good"] * s["top"]["n"] >= s["top"]["good"] * b["n"])
            more = F.struct(F.concat(b["ats"], s["top"]["ats"]).alias("ats"), (b["n"] + s["top"]["n"]).alias("n"), (b["good"] + s["top"]["good"]).alias("good"))
            return F.when(violates, F.struct(s["kept"].alias("kept"), more.cast(block).alias("top"))).otherwise(F.struct(F.concat(F.array(b), s["kept"]).alias("kept"), s["top"].alias("top")))

        done = F.aggregate(F.reverse(blocks), state, step)
        return F.transform(F.array(done), lambda x: F.concat(x["kept"], F.array(x["top"])))[0]

    blocks = F.aggregate(points, F.array().cast(f"array<{block}>"), lambda bs, p: joined(bs, F.struct(F.array(p["at"].cast("bigint")).alias("ats"), p["n"].cast("bigint").alias("n"), p["good"].cast("bigint").alias("good"))))
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["ats"], lambda a: F.struct(a.alias("at"), (b["good"].cast("double") / b["n"].cast("double")).alias("confidence")))))


def calibration(reviews: DataFrame, rule: str, score: str, right: str) -> DataFrame:
    """rule, score, confidence: how often values of a rule with that raw score were right, never falling as the score rises.

    score: whole numbers of a bounded range (hundredths); right: 1 or 0. Reviews are added up by rule and score before they are
    moved, so that a rule's group has as many rows as there are scores. Null scores and verdicts don't count.
    """
    counts = reviews.where(F.col(score).isNotNull() & F.col(right).isNotNull()).groupBy(rule, score).agg(F.count("*").alias("n"), F.sum(F.col(right).cast("long")).alias("good"))
    points = counts.groupBy(rule).agg(F.array_sort(F.collect_list(F.struct(F.col(score).alias("at"), "n", "good"))).alias("points"))
    return points.select(rule, F.inline(pool(F.col("points")))).withColumnRenamed("at", score)


def calibrated(fields: DataFrame, curve: DataFrame, rule: str, score: str) -> DataFrame:
    """fields with `confidence`: that of the rule's highest reviewed score not over the value's, else of its lowest; null for a rule without reviews. The curve has a row for each rule and score."""
    lines = curve.groupBy(rule).agg(F.array_sort(F.collect_list(F.struct(F.col(score).alias("at"), "confidence"))).alias("__line"))
    below = F.filter("__line", lambda x: x["at"] <= F.col(score))
    value = F.coalesce(F.element_at(F.when(F.size(below) > 0, below), -1), F.get("__line", F.lit(0)))["confidence"]
    return fields.join(F.broadcast(lines), rule, "left").withColumn("confidence", value).drop("__line")


def document_confidence(fields: DataFrame, key: str, hundredths: str) -> DataFrame:
    """Least and mean confidence of each document, from whole hundredths so that sums are exact."""
    total, n = F.sum(hundredths).cast("double"), F.count("*").cast("double")
    return fields.groupBy(key).agg((F.min(hundredths).cast("double") / 100).alias("min_confidence"), (total / (n * 100)).alias("avg_confidence"))


def ocr_confidence(results: DataFrame, document: str = "document_id", confidence: str = "confidence_score") -> DataFrame:
    """Pages, least and mean OCR confidence of each document; the mean is of whole ten-thousandths, so that sums are exact."""
    parts = F.round(F.col(confidence) * 10_000).cast("long")
    return results.groupBy(document).agg(
        F.count("*").alias("n_pages"), (F.min(parts).cast("double") / 10_000).alias("min_confidence"), (F.sum(parts).cast("double") / (F.count(parts).cast("double") * 10_000)).alias("avg_confidence"),
    )


def review_queue(fields: DataFrame, confidence: str, verified: str, threshold: float) -> DataFrame:
    """Fields under the threshold that nobody has verified."""
    return fields.where((F.col(confidence) < threshold) & ~F.col(verified))


def review_overlay(fields: DataFrame, reviews: DataFrame, key: str, value: str, missing: Column) -> DataFrame:
    """Reviewed values take the original's place; `reviewed` says where."""
    return fields.join(reviews.select(key, F.col(value).alias("__value")), key, "left").select(
        key, F.coalesce("__value", missing).alias(value), F.col("__value").isNotNull().alias("reviewed")
    )
