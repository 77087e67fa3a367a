"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to
Latin ones, digits inside words to the letters they stand for. The lexicon's
terms are whole words or word beginnings with a weight each; the weights of
the terms in a text, outside exception phrases, are summed and normalised by
the text's length, and a logistic curve turns that into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, pieces

#: Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ⅼ": "l", "ⅰ": "i",
}
#: Digits and signs that stand for letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "pond scum", "clown fish", "class clown")

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_FOLD |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF), None)
#: No part of a word: white space and punctuation beyond ASCII.
_FOLD |= dict.fromkeys((0x85, *range(0xA0, 0xAA), 0xAB, 0xAC, *range(0xAE, 0xB2), 0xB4, *range(0xB6, 0xB9), 0xBB, 0xBF, *range(0x2000, 0x200B), *range(0x2010, 0x2070), 0x3000, 0x3001, 0x3002), " ")
_LOOKS = re.compile(f"[{re.escape(''.join(map(chr, _FOLD)))}]")
_DIGITS = {ord(k): v for k, v in DIGITS.items()}
_SIGNS = "".join(k for k in DIGITS if not k.isdigit())
#: Of ASCII, letters, digits and the signs above make words; the rest is a gap.
_GAP = bytes(c if c >= 0x80 or chr(c).isalnum() or chr(c) in _SIGNS else 0x20 for c in range(256))
_ODD = re.compile(f"[0-9{re.escape(_SIGNS)}]")


def _letters(word: str) -> str:
    """A word with digits or signs: signs at its ends go; what stands among letters becomes letters."""
    if word.isalpha():
        return word
    word = word.strip(_SIGNS)
    if any(c.isalpha() for c in word):
        return word.translate(_DIGITS)
    return "".join(" " if c in _SIGNS else c for c in word).strip()


def fold(text: str) -> str:
    """Folded words with one space around each."""
    text = text.lower()
    if not text.isascii() and _LOOKS.search(text):
        text = text.translate(_FOLD)
    words = text.encode().translate(_GAP).decode().split()
    if _ODD.search(text):
        words = " ".join([_letters(w) for w in words]).split()
    return f" {' '.join(words)} "


def terms(words: set[str], shortest: int, longest: int) -> set[str]:
    """'word ' for the words and 'beginning' for their beginnings of these lengths."""
    found = {f"{w} " for w in words}
    for n in range(shortest, longest + 1):
        found.update(w[:n] for w in words if len(w) > n)
    return found


@dataclass
class Model:
    weights: dict[str, float]  # 'word ' or 'beginning' -> weight
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0)  # bias, by log of the sum, by log of the density
    automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def ready(self) -> Model:
        if self.automaton is None:
            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(" " + t, (len(t) + 1, w))
            for p in self.exceptions:
                a.add_word(f" {p} ", (len(p) + 2, None))
            if len(a):
                a.make_automaton()
            self.automaton = a
        return self

    def features(self, flat: str) -> tuple[float, float]:
        """log(1 + summed weight) and log(1 + summed weight for each 100 words); a word counts by its heaviest term."""
        words = max(1, flat.count(" ") - 1)
        if not len(self.automaton):
            return 0.0, 0.0
        best: dict[int, float] = {}
        waived: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton.iter(flat):
            start = end - n + 1
            if w is None:
                waived.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        total = sum(w for s, w in best.items() if not any(a <= s < b for a, b in waived))
        return math.log1p(total), math.log1p(100.0 * total / words)

    def score(self, f: tuple[float, float]) -> float:
        if not self.weights:
            return 0.0
        z = self.curve[0] + self.curve[1] * f[0] + self.curve[2] * f[1]
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def _sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """toxic and text of about `most` labelled rows at most, by hashed id; that bounds the side that is broadcast."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) == 1).alias("__toxic"))
    share = min(1.0, most / max(1, known.count()))
    spread = F.pmod(F.xxhash64(F.col("__id"), F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    known = known.where(spread < share).groupBy("__id").agg(F.max("__toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    # a few thousand texts: dealt out anew, so that a few large input splits do not hold the training up
    return rows.join(F.broadcast(known), "__id").select("toxic", "text").repartition(32)


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, support: int = 6, shortest: int = 4, longest: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns the lexicon's weights and the curve from labelled rows, about `most` of them at most.

    A term's weight is the log of its document rate among toxic texts over
    that among the others. It enters with `support` toxic texts at least, a weight of
    2 and a z-score of 3, or of sqrt(2 ln n) if n terms with that support make more
    chance finds likely. All such terms enter; the sample bounds their number.
    Without toxic labels the lexicon is empty.
    """
    sample = _sample(docs, labels, most, id_col, text_col, label_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for part in pieces(batch, 1):
                for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found[toxic].update(terms(set(fold(text or "").split()), shortest, longest))
        seen = found[True]
        rows = [(t, n, found[False][t]) for t, n in seen.items()]
        rows += [(t, 0, n) for t, n in found[False].items() if t not in seen]
        for k in range(0, len(rows), 50_000):
            cut = rows[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in cut], pa.string()), pa.array([r[1] for r in cut], pa.int64()), pa.array([r[2] for r in cut], pa.int64())], names=["term", "toxic", "clean"])

    counted = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = sample.agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).first()
    nt, nc = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(nt / (totals["toxic"] + 1.0)) - F.log(nc / (totals["clean"] + 1.0))
    # counted once: the candidates are few beside the terms
    chosen = cut(counted.where(F.col("toxic") >= support).withColumn("weight", weight).withColumn("z", F.col("weight") / F.sqrt(1 / nt + 1 / nc)))
    bound = max(3.0, math.sqrt(2 * math.log(max(1, chosen.count()))))
    rows = chosen.where((F.col("weight") >= 2) & (F.col("z") >= bound)).select("term", "weight").collect()
    model = Model({r["term"]: float(r["weight"]) for r in sorted(rows)})
    if not model.weights:
        return model
    shared = model

    def make():
        m = shared.ready()
        return lambda texts: [m.features(fold((t or b"").decode("utf-8", "replace"))) for t in texts]

    points = map_texts(sample, make, "total double, density double", "text", ("toxic",)).toPandas()
    model.curve = logistic(points[["total", "density"]].to_numpy(float), points["toxic"].to_numpy(bool))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, ...]:
    """Bias and slopes by Newton's method; the ridge keeps separable data finite."""
    a = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(a.shape[1]), np.eye(a.shape[1]) * ridge
    keep[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, score and predicted (1 from a score of 0.5) of every whole text.

    Null and empty texts hold no term and score as such. Equal texts score
    alike; repeated rows are each scored; other columns are not read. The
    model's size is bounded by that of the sample it was fitted on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value.ready()

        def rows(texts: list) -> list:
            scores = [m.score(m.features(fold((t or b"").decode("utf-8", "replace")))) for t in texts]
            return [(s, int(s >= 0.5)) for s in scores]

        return rows

    return map_texts(docs, make, "score double, predicted int", text_col, keep)
