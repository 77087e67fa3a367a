"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary becomes a trie. Each state carries a failure link and the
number of pieces that are popped when the link is followed, so that a word is
counted in one pass over its characters and no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from . import wordhash as wh
from .common import map_texts

#: Words kept with their lengths in one task; the table is emptied beyond it.
CACHE_WORDS = 200_000


def read_vocabulary(path: str, end: str = "</w>") -> list[str]:
    """The pieces of a byte-level vocabulary file whose word-final pieces end in `end`."""
    with open(path, encoding="utf-8") as f:
        return sorted(json.load(f)["model"]["vocab"])


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def vocabulary_bytes(pieces: list[str], end: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces as tuples of byte values; 256 stands for the end of a word."""
    back = {c: b for b, c in byte_symbols().items()}
    found = []
    for p in pieces:
        final = p.endswith(end) and p != end
        body = p[: -len(end)] if final else p
        if body and all(c in back for c in body):
            found.append((*(back[c] for c in body), *((256,) if final else ())))
    return found


class Automaton:
    """Counts the pieces that greedy longest-match-first would cut a word into.

    Symbols are the bytes of the word and then 256, its end. A word with a
    place where no piece matches counts as one unknown piece. A word-final
    piece includes the end symbol; a vocabulary may also hold the bare end.
    """

    def __init__(self, vocabulary: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            s = 0
            for c in piece:
                t = self.next[s].get(c)
                if t is None:
                    t = len(self.next)
                    self.next[s][c] = t
                    self.next.append({})
                    final.append(False)
                s = t
            final[s] = True
        self.fail: list[int] = [-1] * len(self.next)  # -1: no way on
        self.popped: list[int] = [0] * len(self.next)
        queue = deque((0, c, t) for c, t in self.next[0].items())
        while queue:
            parent, c, s = queue.popleft()
            if final[s]:
                self.fail[s], self.popped[s] = 0, 1
            else:
                z, n = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[s], self.popped[s] = self.next[z][c], n
            queue.extend((s, d, t) for d, t in self.next[s].items())
        # the same as arrays, for many words at once: transitions by state * 257 + symbol
        steps = sorted((s * 257 + c, t) for s, own in enumerate(self.next) for c, t in own.items())
        self.keys, self.targets = np.array([k for k, _ in steps] or [-1], np.int64), np.array([t for _, t in steps] or [0], np.int32)
        self.fails, self.pops = np.array(self.fail, np.int32), np.array(self.popped, np.int32)

    def count(self, word: bytes) -> int:
        """Pieces of one word; an empty word has none."""
        if not word:
            return 0
        s = n = 0
        nxt, fail, popped = self.next, self.fail, self.popped
        for c in (*word, 256):
            t = nxt[s].get(c)
            while t is None:
                if fail[s] < 0:
                    return n if c == 256 and s == 0 else 1
                n += popped[s]
                s = fail[s]
                t = nxt[s].get(c)
            s = t
        while s:
            if fail[s] < 0:
                return 1
            n += popped[s]
            s = fail[s]
        return n


    def counts(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """count() of the words of bytes b between starts and ends, all words a symbol at a time."""
        out, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        state, at = np.zeros(len(starts), np.int64), np.array(starts, np.int64)
        open_ = np.flatnonzero(ends > starts)
        while len(open_):
            place, last = at[open_], ends[open_]
            symbol = np.where(place < last, b[np.minimum(place, len(b) - 1)].astype(np.int64), 256)
            key = np.where(place > last, -2, state[open_] * 257 + symbol)  # beyond the end nothing matches
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            go = open_[hit]
            state[go] = self.targets[found[hit]]
            at[go] += 1
            stay, symbol, over = open_[~hit], symbol[~hit], (place > last)[~hit]
            here = state[stay]
            back = self.fails[here]
            ended = (here == 0) & (over | (symbol == 256))
            unknown = ~ended & (back < 0)
            out[stay[ended]] = n[stay[ended]]
            out[stay[unknown]] = 1
            on = ~ended & ~unknown
            n[stay[on]] += self.pops[here[on]]
            state[stay[on]] = back[on]
            open_ = np.concatenate([go, stay[on]])
        return out


def greedy_count(word: bytes, vocabulary: set[tuple[int, ...]]) -> int:
    """The same by trial of every length; what the tests hold the automaton against."""
    symbols, i, n = (*word, 256), 0, 0
    while word and i < len(symbols):
        j = next((j for j in range(len(symbols), i, -1) if symbols[i:j] in vocabulary), None)
        if j is None:
            return n if symbols[i:] == (256,) else 1
        i, n = j, n + 1
    return n


#: The three classes of bytes that make pre-tokens; all others are 0.
_CLASSES = np.zeros(256, np.int8)
_CLASSES[0x21:0x7F] = 3
_CLASSES[[c for c in range(256) if c >= 0x80 or chr(c).isascii() and chr(c).isalpha()]] = 2
_CLASSES[0x30:0x3A] = 1


def pretokens(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one class."""
    kind = np.concatenate([[0], _CLASSES[np.frombuffer(buffer, np.uint8)], [0]])
    turns = np.flatnonzero(kind[1:] != kind[:-1])
    some = kind[turns + 1] > 0
    return turns[some], turns[np.flatnonzero(some) + 1]


def token_counts(docs: DataFrame, vocabulary: list[tuple[int, ...]], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_pretokens and n_tokens of each row's lower-cased text.

    Pre-tokens are runs of ASCII digits, of letters (ASCII, or anything beyond
    ASCII), or of other visible ASCII. Only A-Z are lower-cased. A null text
    counts as empty; empty texts have 0 of both; equal rows are each counted;
    other columns are not read. The vocabulary is of fixed size (a file's), so
    its automaton is sent to the executors once as a broadcast variable. The
    automaton runs once for each distinct pre-token of some texts, told apart by 64-bit hashes.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))

    def make():
        counts, seen = automaton.value.counts, {}

        def lengths(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
            """Start and number of pieces of each pre-token."""
            starts, ends = pretokens(buffer)
            kinds, first, which = np.unique(wh.hash_spans(np.frombuffer(buffer, np.uint8), starts, ends), return_index=True, return_inverse=True)
            if len(seen) > CACHE_WORDS:
                seen.clear()
            known = [seen.get(h, -1) for h in kinds.tolist()]
            found = np.array(known, np.int64)
            new = np.flatnonzero(found < 0)
            found[new] = counts(np.frombuffer(buffer, np.uint8), starts[first[new]], ends[first[new]])
            seen.update(zip(kinds[new].tolist(), found[new].tolist(), strict=True))
            return starts, found[which]

        def rows(texts: list) -> list:
            words, pieces = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            held: list[tuple[int, bytes]] = []
            size = 0

            def flush() -> None:
                nonlocal held, size
                if held:
                    at = np.array([k for k, _ in held])
                    ends = np.cumsum([len(t) + 1 for _, t in held])
                    starts, n = lengths(b"\n".join(t for _, t in held))
                    own = at[np.searchsorted(ends, starts, "right")]
                    np.add.at(words, own, 1)
                    np.add.at(pieces, own, n)
                held, size = [], 0

            for k, text in enumerate(texts):
                for part in wh.parts((text or b"").lower()):
                    if size + len(part) > wh.PIECE:
                        flush()
                    held.append((k, part))
                    size += len(part) + 1
            flush()
            return list(zip(words.tolist(), pieces.tolist(), strict=True))

        return rows

    return map_texts(docs, make, "n_pretokens long, n_tokens long", text_col, keep)
