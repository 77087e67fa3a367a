"""LM scoring by a probabilistic suffix tree.

States are contexts of 0 to `depth` tokens. A context is considered from
`least` training occurrences on; it holds the continuations that follow it (`keep` times
or more, if it has several tokens), and is retained if these diverge from its suffix's: the log likelihood
ratio of its held continuations against the suffix state's, less half the log of its
count for each of them, is not negative. A token is scored in the state of the longest
retained suffix of what stands before it; a state's held counts are discounted, and
all that is not held goes to its suffix state's distribution, down to the root's
add-one distribution.

Counts are sums over the whole training corpus. The tree is never in
one place: documents are read in chunks of some megabytes, which are kept as
packed numbers. Level by level a chunk tells its distinct n-grams and their counts
to buckets of hashes and is answered with the corpus' counts for just these, so
that what a chunk holds is bounded by its own text. An n-gram is told only if the
n-grams within it are frequent enough to let it matter.

Chunks and buckets both grow with the corpus, so that telling each bucket directly
would take rows that grow with the square of it. Beyond DIRECT buckets, chunks
tell DISTRICTS districts instead; a relay takes what a group of chunks tells a district, adds it up,
asks the district's buckets and answers its chunks. Groups have as many chunks
as districts have buckets, so that a chunk costs 2 * DISTRICTS rows a level
at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .chunks import arrow_schema, slices, squeeze, stretch
from .common import cut

#: The token after a text's last word.
END = np.uint64(0x5EED5EED5EED5EED)
#: Bytes of text in a chunk, and in what a bucket stands for, about.
CHUNK, BUCKET = 12 << 20, 4 << 20
#: Buckets that chunks tell directly; beyond, they tell so many districts.
DIRECT, DISTRICTS = 4096, 256
STATE = "chunk long, ids array<long>, sizes binary, train binary, kinds binary, codes binary"
TOLD = "bucket int, chunk long, level int, keys binary, counts binary"
ANSWERED = "chunk long, level int, bucket int, totals binary, owned binary, tokens long, kinds long"
#: Of a context: its held continuations' part of the test, their number and the sum of their counts.
TALLY = np.dtype([("part", np.float32), ("kinds", np.uint32), ("held", np.uint64)])
#: Of a retained context; zeros for others.
STANDING = np.dtype([("kinds", np.uint32), ("held", np.uint64)])


@dataclass(frozen=True)
class Tree:
    """What decides the tree; `tokens` and `kinds`: the training corpus' tokens and distinct ones."""

    depth: int
    least: int
    keep: int
    discount: float
    bits: int  # of the number of buckets
    district_bits: int  # of the number of districts; 0: buckets are told directly
    tokens: int = 0
    kinds: int = 0


def ascending(keys: np.ndarray) -> np.ndarray:
    """A stable sorting order. Keys are sorted with their places in the lowest bits, which is faster than sorting places; should keys differ only in bits that this takes, places are sorted."""
    bits = max(1, (len(keys) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    s = keys[order]
    return order if (s[1:] >= s[:-1]).all() else np.argsort(keys, kind="stable")


def shrink(counts: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes, squeezed."""
    most = int(counts.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + squeeze(counts.astype(kind))


def grow(data: bytes) -> np.ndarray:
    return stretch(data[1:], np.dtype(f"u{data[0]}")).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys ascending, and each place's among them."""
    order = ascending(keys)
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    kind = np.empty(len(keys), np.int32)
    kind[order] = np.cumsum(new, dtype=np.int32) - 1
    return s[new], kind


def encode(chunk: int, ids: list, texts: list[bytes | None], train: list[bool]) -> dict:
    """One row of STATE: the tokens as places in the chunk's distinct ones."""
    words, offsets = wh.hash_words(texts, lower=True)
    tokens = np.full(len(words) + len(texts), END)
    tokens[np.arange(len(words)) + wh.owners(offsets)] = words
    sizes = np.diff(offsets) + 1
    kinds, codes = distinct(tokens)
    return {
        "chunk": [chunk], "ids": [ids], "sizes": [squeeze(sizes.astype(np.uint32))], "train": [np.packbits(train).tobytes()],
        "kinds": [squeeze(kinds, ascending=True)], "codes": [squeeze(codes.astype(np.uint32))],
    }


class Chunk:
    """A chunk's tokens and, as far as it has been answered, what the corpus knows of its n-grams.

    Of level n: `keys[n]` are the distinct n-grams, `kind[n]` is the place among them of the
    n-gram that ends at each token (-1: not asked for), `total[n]` are their counts.
    """

    def __init__(self, state: pa.Table, got: pa.Table | None, tree: Tree, upto: int):
        """upto: the last level of n-grams that has been answered (0: none)."""
        self.tree, self.got = tree, {}
        if got is not None and len(got):
            level, bucket = got["level"].to_numpy(), got["bucket"].to_numpy()
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                self.got[int(k)] = got.take(at[np.argsort(bucket[at])])
        self.id, self.ids = state["chunk"][0].as_py(), state["ids"][0].as_py()
        sizes = stretch(state["sizes"][0].as_py(), np.uint32).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        train = np.unpackbits(np.frombuffer(state["train"][0].as_py(), np.uint8), count=len(sizes)).astype(bool)
        self.train = np.repeat(train, sizes)
        place = (np.arange(self.offsets[-1]) - np.repeat(self.offsets[:-1], sizes)).astype(np.int32)
        self.keys = {1: stretch(state["kinds"][0].as_py(), np.uint64, ascending=True)}
        self.kind = {1: stretch(state["codes"][0].as_py(), np.uint32).astype(np.int32)}
        self.total: dict[int, np.ndarray] = {}
        self.context_at = {2: np.flatnonzero(place >= 1).astype(np.int32)}  # tokens that have a context of n - 1 tokens
        self.hash = self.keys[1][self.kind[1]]  # of the n-gram of the last level that ends at each token
        if upto >= 1:
            self.total[1] = self._totals(1)
            for n in range(2, upto + 1):
                self._level(n)
                self.total[n] = self._totals(n)
            if upto <= tree.depth:
                self._level(upto + 1)

    def _keep(self, n: int) -> int:
        """Occurrences from which a context of n - 1 tokens holds a continuation."""
        return 1 if n == 2 else self.tree.keep

    def _totals(self, level: int) -> np.ndarray:
        """Of n-grams (level n): counts; of contexts (level -n): STANDING."""
        parts = [unpacked(x, level, STANDING) for x in self.got[level]["totals"].to_pylist()] if level in self.got else []
        return np.concatenate(parts) if parts else np.zeros(0, STANDING if level < 0 else np.int64)

    def _owned(self, n: int) -> np.ndarray:
        sizes = np.diff(self.bounds(self.keys[n]))
        parts = self.got[n]["owned"].to_pylist() if n in self.got else []
        bits = [np.unpackbits(stretch(x, np.uint8), count=k) for x, k in zip(parts, sizes[sizes > 0], strict=True)]
        return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)

    def _level(self, n: int) -> None:
        """Finds the n-grams to ask for: their context is considered, and its last n - 1 tokens are held by some state."""
        before = self.kind[n - 1]
        # of the (n - 1)-gram that ends at each token, as far as it matters; the last one is for what was not asked for
        often = np.append(self.total[n - 1], 0)
        considered, held = often >= self.tree.least, often >= self._keep(n)
        at = self.context_at[n]
        self.context_at[n] = at = at[considered[before[at - 1]]]
        here = np.zeros(len(before), bool)
        here[at] = True
        self.context_at[n + 1] = at[here[at - 1]]
        at = at[held[before[at]]]
        hashes = wh.mix(self.hash[at - 1] * np.uint64(wh.FIRST) + self.keys[1][self.kind[1][at]])
        # the bucket's bits and 32 more tell n-grams apart
        self.keys[n], kind = distinct(hashes & ~np.uint64((1 << (32 - self.tree.bits)) - 1))
        self.kind[n] = np.full(len(before), -1, np.int32)
        self.kind[n][at] = kind
        if n <= self.tree.depth:
            self.hash = np.zeros(len(before), np.uint64)
            self.hash[at] = hashes

    def counts(self, n: int) -> np.ndarray:
        """Training occurrences in this chunk of each n-gram."""
        return np.bincount(self.kind[n][self.train & (self.kind[n] >= 0)], minlength=len(self.keys[n])).astype(np.uint64)

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Bounds of the buckets, or of the districts, in ascending keys."""
        bits = self.tree.district_bits or self.tree.bits
        return slices((keys >> np.uint64(64 - bits)).astype(np.int64), 1 << bits)

    def contexts(self, n: int) -> np.ndarray:
        """Kinds of (n - 1)-grams that are considered contexts here."""
        seen = np.zeros(len(self.keys[n - 1]), bool)
        seen[self.kind[n - 1][self.context_at[n] - 1]] = True
        return np.flatnonzero(seen)

    def tallies(self, n: int) -> np.ndarray:
        """TALLY of each of contexts(n), from the held n-grams that this chunk answers for."""
        first, places = np.empty(len(self.keys[n]), np.int32), np.flatnonzero(self.kind[n] >= 0)
        first[self.kind[n][places]] = places
        held = self._owned(n) & (self.total[n] >= self._keep(n))
        at, count = first[held], self.total[n][held].astype(float)
        context = self.kind[n - 1][at - 1]
        whole = self.total[n - 1][context]
        if n == 2:
            suffix = self.root()[self.kind[1][at]]
        else:
            suffix = np.maximum(self.total[n - 1][self.kind[n - 1][at]], count) / self.total[n - 2][self.kind[n - 2][at - 1]]
        part = count * np.log(count / whole / suffix) - 0.5 * np.log(whole)
        wanted, size = self.contexts(n), len(self.keys[n - 1])
        found = np.empty(len(wanted), TALLY)
        found["part"], found["kinds"] = np.bincount(context, weights=part, minlength=size)[wanted], np.bincount(context, minlength=size)[wanted]
        found["held"] = np.bincount(context, weights=count, minlength=size)[wanted].astype(np.uint64)
        return found

    def root(self) -> np.ndarray:
        """Each distinct token's probability in the root."""
        return (self.total[1] + 1.0) / (self.tree.tokens + self.tree.kinds + 1.0)

    def log_probabilities(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's log10 probability by the states of contexts of up to 0, 1, ... depth tokens, and the length of each token's state's context."""
        p = self.root()[self.kind[1]]
        texts = [np.add.reduceat(np.log10(p), self.offsets[:-1])]
        length, discount = np.zeros(len(p), np.int32), self.tree.discount
        for n in range(2, self.tree.depth + 2):
            standing = np.zeros(len(self.keys[n - 1]), STANDING)
            standing[self.contexts(n)] = self._totals(-n)
            at = self.context_at[n]
            context = self.kind[n - 1][at - 1]
            use = standing["kinds"][context] > 0
            at, context = at[use], context[use]
            kind = self.kind[n][at]
            count = np.where(kind >= 0, self.total[n][kind], 0) if len(self.keys[n]) else np.zeros(len(at))
            count = np.where(count >= self._keep(n), count - discount, 0.0)
            own = standing[context]
            # n-grams that share a hash can hold more than their context occurs
            whole = np.maximum(self.total[n - 1][context], own["held"].astype(np.int64)).astype(float)
            p[at] = (np.minimum(count, whole) + (whole - own["held"] + discount * own["kinds"]) * p[at]) / whole
            length[at] = n - 1
            texts.append(np.add.reduceat(np.log10(p), self.offsets[:-1]))
        return texts, length

    def told(self, levels: list[tuple[int, np.ndarray, np.ndarray]]) -> dict:
        """Rows of TOLD from (level, keys, what is told of each)."""
        out: dict = {"bucket": [], "level": [], "keys": [], "counts": []}
        for level, keys, counts in levels:
            bounds = self.bounds(keys)
            used = np.flatnonzero(np.diff(bounds)).tolist()
            out["bucket"] += used
            out["keys"] += [squeeze(keys[bounds[b] : bounds[b + 1]], ascending=True) for b in used]
            out["counts"] += [packed(counts[bounds[b] : bounds[b + 1]], level) for b in used]
            out["level"] += [level] * len(used)
        out["chunk"] = [self.id] * len(out["bucket"])
        return out

    def asks(self, n: int) -> dict:
        """What is told when the levels under n have been answered: n-grams of n tokens and the contexts of those before."""
        levels = [(n, self.keys[n], self.counts(n))] if n <= self.tree.depth + 1 else []
        if n > 2:
            levels.append((1 - n, self.keys[n - 2][self.contexts(n - 1)], self.tallies(n - 1)))
        return self.told(levels)


def mixture(values: list[np.ndarray]) -> np.ndarray:
    """log10 of the mean of probabilities that are given as log10."""
    most = np.max(values, axis=0)
    return most + np.log10(np.mean([10 ** (v - most) for v in values], axis=0))


def packed(values: np.ndarray, level: int) -> bytes:
    """Counts of n-grams, or TALLY or STANDING of contexts (levels under 0)."""
    return squeeze(values) if level < 0 else shrink(values)


def unpacked(data: bytes, level: int, kind: np.dtype) -> np.ndarray:
    return stretch(data, kind) if level < 0 else grow(data)


def _merged(rows: pa.Table, level: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the rows' arrays, all keys and counts, an order that sorts the keys, starts of equal ones in it, and each one's key's place among the distinct."""
    keys = [stretch(x, np.uint64, ascending=True) for x in rows["keys"].to_pylist()]
    sizes = [len(x) for x in keys]
    keys = np.concatenate(keys)
    counts = np.concatenate([unpacked(x, level, TALLY) for x in rows["counts"].to_pylist()])
    order = ascending(keys)
    s = keys[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return sizes, keys, counts, order, first, which


def _sums(counts: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    if counts.dtype == TALLY:
        out = np.empty(len(first), TALLY)
        for name, kind in (("part", np.float64), ("kinds", np.uint32), ("held", np.uint64)):
            out[name] = np.add.reduceat(counts[name][order].astype(kind), first)
        return out
    return np.add.reduceat(counts[order], first)


def _by_level(rows: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    levels = rows["level"].to_numpy()
    for level in np.unique(levels).tolist():
        own = rows.take(np.flatnonzero(levels == level))
        yield level, own.sort_by([("chunk", "ascending"), ("bucket", "ascending")])


def _answer(rows: pa.Table) -> dict:
    """A bucket's answers: each asker's keys get their totals over all, in the order in which they were told; one asker owns each."""
    out: dict = {"chunk": [], "level": [], "bucket": [], "totals": [], "owned": [], "tokens": [], "kinds": []}
    for level, own in _by_level(rows):
        sizes, _, counts, order, first, which = _merged(own, level)
        total = _sums(counts, order, first)
        if level < 0:
            good = total["part"] >= 0
            answers = np.zeros(len(total), STANDING)
            answers["kinds"], answers["held"] = np.where(good, total["kinds"], 0), np.where(good, total["held"], 0)
        else:
            answers = total.astype(np.int64)
        owner = np.zeros(len(which), bool)
        owner[order[first]] = True
        ends = np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends, strict=True):
            out["totals"].append(packed(answers[which[a:b]], level))
            out["owned"].append(squeeze(np.packbits(owner[a:b])) if level > 1 else b"")
        out["chunk"] += own["chunk"].to_pylist()
        out["bucket"] += own["bucket"].to_pylist()
        out["level"] += [level] * len(own)
        # the bucket's part of the corpus' sizes goes to one asker
        out["tokens"] += [int(answers.sum()) if level == 1 else 0] + [0] * (len(own) - 1)
        out["kinds"] += [int((answers > 0).sum()) if level == 1 else 0] + [0] * (len(own) - 1)
    return out


def _relay_asks(rows: pa.Table, bits: int) -> dict:
    """A relay's own rows of TOLD: its chunks' keys and sums, to the buckets of its district."""
    out: dict = {"bucket": [], "chunk": [], "level": [], "keys": [], "counts": []}
    for level, own in _by_level(rows):
        _, keys, counts, order, first, _ = _merged(own, level)
        keys, counts = keys[order][first], _sums(counts, order, first)
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        start = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(start[1:], len(bucket))
        out["bucket"] += bucket[start].tolist()
        out["keys"] += [squeeze(keys[a:b], ascending=True) for a, b in zip(start, ends, strict=True)]
        out["counts"] += [packed(counts[a:b], level) for a, b in zip(start, ends, strict=True)]
        out["level"] += [level] * len(start)
    out["chunk"] = [rows["relay"][0].as_py()] * len(out["bucket"])
    return out


def _relay_answers(rows: pa.Table, got: pa.Table) -> dict:
    """What the buckets told a relay, dealt out to its chunks."""
    out: dict = {"chunk": [], "level": [], "bucket": [], "totals": [], "owned": [], "tokens": [], "kinds": []}
    if not len(rows):
        return out
    answered = dict(_by_level(got))
    for level, own in _by_level(rows):
        sizes, _, _, order, first, which = _merged(own, level)
        answers = [unpacked(x, level, STANDING) for x in answered[level]["totals"].to_pylist()]
        lengths, answers = [len(x) for x in answers], np.concatenate(answers)
        owner = np.zeros(len(which), bool)
        if level > 1:  # what the relay owns, the first of its chunks does
            owned = [np.unpackbits(stretch(x, np.uint8), count=n) for x, n in zip(answered[level]["owned"].to_pylist(), lengths, strict=True)]
            owner[order[first]] = np.concatenate(owned).astype(bool)
        ends = np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends, strict=True):
            out["totals"].append(packed(answers[which[a:b]], level))
            out["owned"].append(squeeze(np.packbits(owner[a:b])) if level > 1 else b"")
        out["chunk"] += own["chunk"].to_pylist()
        out["bucket"] += own["bucket"].to_pylist()
        out["level"] += [level] * len(own)
        for size in ("tokens", "kinds"):
            out[size] += [sum(answered[level][size].to_pylist())] + [0] * (len(own) - 1)
    return out


def exchange(told: DataFrame, tree: Tree, groups: int) -> DataFrame:
    """What the corpus answers to what chunks told: rows of ANSWERED. groups: of chunks, for the relays."""
    answered = arrow_schema(told, ANSWERED)

    def asked(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket").applyInArrow(lambda t: pa.table(_answer(t), schema=answered), ANSWERED)

    if not tree.district_bits:
        return asked(told)
    relays = told.withColumn("relay", F.col("bucket").cast("long") * groups + F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    telling = arrow_schema(told, TOLD)
    bits = tree.bits
    asks = relays.groupBy("relay").applyInArrow(lambda t: pa.table(_relay_asks(t, bits), schema=telling), TOLD)
    answers = asked(asks).withColumn("relay", F.col("chunk"))
    return relays.groupBy("relay").cogroup(answers.groupBy("relay")).applyInArrow(lambda t, got: pa.table(_relay_answers(t, got), schema=answered), ANSWERED)


def states(docs: DataFrame, train: Column, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """STATE of the chunks: rows of one input partition, one after another, up to chunk_bytes of text or one text."""
    schema = arrow_schema(docs, STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        ids, texts, trained, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, ids, texts, trained, size
            if ids:
                yield from pa.table(encode(chunk, ids, texts, trained), schema=schema).to_batches()
                chunk += 1
            ids, texts, trained, size = [], [], [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size + len(row[1] or b"") > chunk_bytes:
                    yield from flush()
                ids.append(row[0])
                texts.append(row[1])
                trained.append(row[2])
                size += len(row[1] or b"")
        yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return rows.mapInArrow(run, STATE)


def suffix_tree_scores(docs: DataFrame, train: Column, depth: int = 3, least: int = 4, keep: int = 1, discount: float = 0.7, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET, direct: int = DIRECT, districts: int = DISTRICTS) -> DataFrame:
    """Scores every whole text with a tree learned from the rows for which `train` holds.

    A-Z are lower-cased; tokens are the runs of anything but ASCII white space
    and one end. Returns the id, n_tokens, n_known (tokens of the training
    corpus), train_tokens, base_score (log10 by the root alone), score (log10 by
    the tree), mean_context (tokens of context used, on average) and mixed_score: log10 of the mean of the text's
    probabilities by the trees of 0, 1, ... depth tokens of context. The tree trusts contexts that training texts repeat, and so
    gives a text that goes on otherwise after them much less than the root does; mixed_score is never
    under base_score or score by more than log10(depth + 1). Null and
    empty texts are one end token. Equal texts score alike; rows that share an
    id are separate texts. Without training rows every token has the root's
    probability 1 / (0 + 0 + 1). Other columns are not read. Documents are read twice, and
    again where an executor is lost; they must then come in the same order, as from files or a checkpoint.

    Tokens are told apart by 64-bit hashes, longer n-grams by 32 bits and as
    many more as there are bits in the number of buckets, which grows with the corpus (40 at least).
    Contexts are of 0 to `depth` tokens. Executors with more memory may take larger chunks and buckets.
    """
    if not 1 <= depth or keep > least:
        raise ValueError("depth must be 1 or more, and keep at most least")
    state = states(docs, train, id_col, text_col, chunk_bytes)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(32, max(8, (-(-total // bucket_bytes)).bit_length()))
    via = (districts - 1).bit_length() if 1 << bits > direct else 0
    groups = max(1, -(-total // chunk_bytes) >> (bits - via)) if via else 1
    return scores_of(state, Tree(depth, least, keep, discount, bits, via), groups).withColumnRenamed("id", id_col)


def tell_words(state: DataFrame, tree: Tree) -> DataFrame:
    """Rows of TOLD of the first level: needs no answers, so no chunk has to be moved."""
    schema = arrow_schema(state, TOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = Chunk(pa.Table.from_batches([batch.slice(k, 1)]), None, tree, 0)
                yield from pa.table(c.told([(1, c.keys[1], c.counts(1))]), schema=schema).to_batches()

    return state.mapInArrow(run, TOLD)


def tell(state: DataFrame, answers: DataFrame, tree: Tree, n: int) -> DataFrame:
    """Rows of TOLD once the levels under n have been answered."""
    schema = arrow_schema(state, TOLD)

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        return pa.table(Chunk(rows, got, tree, n - 1).asks(n), schema=schema)

    return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, TOLD)


def scores_of(state: DataFrame, tree: Tree, groups: int) -> DataFrame:
    """The texts' scores from the chunks' states."""
    words = cut(exchange(tell_words(state, tree), tree, groups))
    sums = words.agg(F.sum("tokens"), F.sum("kinds"), F.countDistinct("chunk")).first()
    tree = replace(tree, tokens=sums[0] or 0, kinds=sums[1] or 0)
    # so many chunks a partition; chunks and answers are dealt alike, each once
    parts = max(1, min(sums[2], 20_000))
    state, answers = state.repartition(parts, "chunk"), words.repartition(parts, "chunk")
    for n in range(2, tree.depth + 3):
        answers = answers.union(exchange(tell(state, answers, tree, n), tree, groups).repartition(parts, "chunk"))
    out = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_context double, mixed_score double"
    schema = arrow_schema(state, out)

    def score(rows: pa.Table, got: pa.Table) -> pa.Table:
        c = Chunk(rows, got, tree, tree.depth + 1)
        values, length = c.log_probabilities()
        start, sizes = c.offsets[:-1], np.diff(c.offsets)
        return pa.table({
            "id": pa.array(c.ids, pa.int64()), "n_tokens": sizes,
            "n_known": np.add.reduceat((c.total[1][c.kind[1]] > 0).astype(np.int64), start),
            "train_tokens": np.full(len(start), tree.tokens, np.int64),
            "base_score": values[0], "score": values[-1], "mean_context": np.add.reduceat(length, start) / sizes, "mixed_score": mixture(values),
        }, schema=schema)

    return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, out)
