"""Language ID: averaged hashed subword embeddings with a linear softmax.

Every run of 3 and of 4 bytes of the lower-cased text, white space folded to
one space, is hashed to a row of an embedding table; the mean of the rows goes
through a linear layer and a softmax. The table and the layer are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows.
Sums over a text are of whole numbers, so that a text's score does not depend
on what is scored beside it or on where a long text is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, map_texts

BUCKETS = 1 << 15
#: Bytes that the longest run takes beyond its first.
AHEAD = 3
#: The table holds multiples of 1 / SCALE.
SCALE = 1 << 16
#: A-Z become a-z; what is ASCII and no letter becomes a space.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def flatten(text: bytes) -> bytes:
    return b" " + b" ".join(text.translate(_TABLE).split()) + b" "


def grams(buffer: bytes) -> np.ndarray:
    """Buckets of the runs of 3 and of 4 bytes from each byte on but the last AHEAD ones: row 0 and row 1."""
    b = np.frombuffer(buffer, np.uint8).astype(np.uint32)
    three = b[:-3] + (b[1:-2] << np.uint32(8)) + (b[2:-1] << np.uint32(16))
    mixed = np.stack([three, three + (b[3:] << np.uint32(24)) + np.uint32(1)])
    mixed *= np.uint32(2654435761)
    return (mixed >> np.uint32(17)).astype(np.int32)


def padded(flat: bytes) -> bytes:
    """A flattened text and spaces after it, so that a run starts at each of its bytes."""
    return flat + b" " * AHEAD


def features(text: bytes) -> tuple[list[int], list[int]]:
    """Buckets and their counts, of the whole text."""
    kinds, counts = np.unique(grams(padded(flatten(text))), return_counts=True)
    return kinds.tolist(), counts.tolist()


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs: embeddings times the linear layer, in whole multiples of 1 / SCALE (int32)
    bias: np.ndarray
    heat: float  # the logits are multiplied by it; fitted for calibrated scores
    floor: float  # scores below it are rejected

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits * self.heat
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Mean table row over each whole text, plus the bias. A text's logits are the same beside any others."""
        width = len(self.langs)
        total, sizes = np.zeros((len(texts), width), np.int64), np.zeros(len(texts), np.int64)
        most = max(1 << 16, (8 << 20) // max(4, width))
        batch, held = [], 0

        def flush() -> None:
            nonlocal batch, held
            if not batch:
                return
            rows = grams(b"".join(padded(f) for _, f in batch) + b" " * AHEAD)
            lengths = np.array([len(f) for _, f in batch])
            starts = np.concatenate([[0], np.cumsum(lengths + AHEAD)[:-1]])
            bounds = np.column_stack([starts, starts + lengths]).ravel()  # each text, then its padding, whose runs do not count
            np.add.at(total, [k for k, _ in batch], np.add.reduceat(self.table[rows[0]] + self.table[rows[1]], bounds, axis=0, dtype=np.int64)[::2])
            batch, held = [], 0

        for k, text in enumerate(texts):
            flat = flatten(text)
            sizes[k] = len(flat)
            if len(flat) <= most:
                if held + len(flat) > most:
                    flush()
                batch.append((k, flat))
                held += len(flat)
                continue
            flat = padded(flat)
            for i in range(0, len(flat) - AHEAD, most):  # parts overlap by what a run looks ahead
                total[k] += self.table[grams(flat[i : i + most + AHEAD])].sum(axis=(0, 1), dtype=np.int64)
        flush()
        return total / SCALE / (2 * sizes[:, None]) + self.bias


def train(rows: list[tuple[str, list[int], list[int]]], dim: int = 16, epochs: int = 6, rate: float = 2.0, reject: float = 0.01, seed: int = 7) -> Model:
    """rows: (lang, buckets, counts). Every fifth row is kept apart to calibrate the scores and the rejection.

    The rejection floor is the score that `reject` of the rows kept apart fall below.
    """
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.int32), np.zeros(0), 1.0, 0.0)
    rng, code = np.random.default_rng(seed), {x: i for i, x in enumerate(langs)}
    embed = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    data = [(code[x], np.array(b, np.int32), (np.array(c, np.float32) / max(1, sum(c)))) for x, b, c in rows if b]
    order = rng.permutation(len(data))
    fit = [data[i] for k, i in enumerate(order) if k % 5 or len(data) < 20]
    apart = [data[i] for k, i in enumerate(order) if not k % 5 or len(data) < 20]
    steps, done = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            y, b, share = fit[i]
            pace = rate * (1 - done / steps)
            done += 1
            hidden = share @ embed[b]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= pace * np.outer(hidden, p)
            bias -= 0.1 * pace * p
            embed[b] -= pace * 10 * share[:, None] * back
    table = np.rint((embed @ layer).astype(np.float64) * SCALE).astype(np.int32)
    z = np.array([share @ table[b] / SCALE + bias for _, b, share in apart], np.float64)
    y = np.array([r[0] for r in apart])

    def loss(heat: float) -> float:
        s = z * heat
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    heat = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
    model = Model(langs, table, bias, heat, 0.0)
    model.floor = float(np.quantile(model.scores(z).max(axis=1), reject))
    return model


def fit(labelled: DataFrame, per_lang: int = 400, most: int = 40_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Trains on about `per_lang` rows of each language, and on about `most` rows in all.

    The sample is bounded by these: of a language, the rows whose hashed id
    falls below what it may have over the language's row count. Features are made on the executors
    from whole texts; only bucket counts (BUCKETS at most a row) come back.
    """
    known = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("n")))
    each = min(per_lang, most / max(1, counts.count()))
    spread = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(F.col("text").rlike(r"\p{L}")).join(lookup(counts), "lang").where(spread < F.lit(float(each)) / F.col("n")).select("lang", "text").repartition(32)

    def make():
        return lambda texts: [features(t or b"") for t in texts]

    found = map_texts(sample, make, "buckets array<int>, counts array<int>", "text", ("lang",)).collect()
    return train(sorted((r["lang"], r["buckets"], r["counts"]) for r in found))


def language_id(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, lang_pred, score and rejected of every whole text.

    Null texts and texts without a letter get 'und' and score 0, rejected; so
    does any text if nothing was learned. Score is the calibrated probability
    of lang_pred; `rejected` marks scores below the calibrated floor. Equal
    texts are predicted alike, wherever they stand; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def rows(texts: list) -> list:
            known = [k for k, t in enumerate(texts) if t and m.langs and _LETTER.search(t.decode("utf-8", "replace"))]
            out: list[tuple] = [("und", 0.0, True)] * len(texts)
            if known:
                s = m.scores(m.logits([texts[k] for k in known]))
                best = s.argmax(axis=1)
                for k, b, row in zip(known, best, s, strict=True):
                    out[k] = (m.langs[b], float(row[b]), bool(row[b] < m.floor))
            return out

        return rows

    return map_texts(docs, make, "lang_pred string, score double, rejected boolean", text_col, keep)
