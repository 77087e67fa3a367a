"""Words of many texts as arrays of 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once.
PIECE = 1 << 20
#: Odd bases of the polynomials over bytes and over words.
BYTES, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a hash's entropy over all its bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The longest powers so far of each base; shorter ones are their beginnings.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of an odd base and of its inverse, modulo 2**64."""

    def make(b: int, size: int) -> np.ndarray:
        p = np.full(size, b, np.uint64)
        p[:1] = 1
        return np.multiply.accumulate(p)

    kept = _POWERS.get(base)
    if kept is None or len(kept[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        kept = _POWERS[base] = make(base, size), make(pow(base, -1, 1 << 64), size)
    return kept[0][:n], kept[1][:n]


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to its end."""
    up, down = powers(BYTES, len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _hash_buffer(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    b = np.frombuffer(buffer, np.uint8)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[b], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return hash_spans(b, starts, ends), starts


def parts(text: bytes) -> Iterator[bytes]:
    """A long text, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        m = _SPACE.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def hash_words(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the texts' offsets in them (one more than texts)."""
    hashes, counts, buffer, sizes, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal buffer, sizes, size
        if not buffer:
            return
        joined = b"\n".join(buffer)
        h, starts = _hash_buffer(joined.lower() if lower else joined)
        ends = np.cumsum(np.array(sizes) + 1)
        counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        hashes.append(h)
        buffer, sizes, size = [], [], 0

    for text in texts:
        text = text or b""
        if len(text) > PIECE:
            flush()
            own = [_hash_buffer(p.lower() if lower else p)[0] for p in parts(text)]
            hashes.extend(own)
            counts.append(np.array([sum(map(len, own))]))
            continue
        if size + len(text) > PIECE:
            flush()
        buffer.append(text)
        sizes.append(len(text))
        size += len(text) + 1
    flush()
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), offsets.astype(np.int64)


def runs(words: np.ndarray, k: int, base: int = FIRST) -> np.ndarray:
    """Hash of the k words from each place on; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def owners(offsets: np.ndarray) -> np.ndarray:
    """Which text each word is of."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def members(values: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in a sorted pool, and where."""
    if not len(pool):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(pool, values), len(pool) - 1)
    return pool[at] == values, at


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable sorting order and the starts of equal values in it."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
