"""Vectorised word scanning and hashing of UTF-8 texts with numpy.

A word is a maximal run of bytes other than space and U+0009 to U+000D.  All
work runs on pieces of about ``PIECE`` bytes, so memory stays bounded by the
piece plus eight bytes a word, however long a single text is.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SIZE = 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base & _MASK, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * PIECE:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs h[starts:ends] of 64-bit values, equal for equal runs."""
    n = len(h)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(_BASE, n), out=total[1:])
    out = (total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(_SIZE)))


def scan(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (byte offsets) and hashes of the words of a buffer."""
    data = np.frombuffer(buf, np.uint8)
    found, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            cuts = np.flatnonzero(_SEP[data[at:end]])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
            else:
                while end < n and not _SEP[data[end]]:
                    end += 1
        part = data[at:end]
        word = np.zeros(len(part) + 2, np.int8)
        word[1:-1] = ~_SEP[part]
        edge = np.diff(word)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            found.append((s + at, e + at, spans(_BYTE[part], s, e)))
        at = end
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def batches(texts: list[bytes | None], limit: int = PIECE):
    """(first, last + 1) of runs of texts that together have about limit bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def hash_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: word hashes, offset of each text's first word (one more
    entry than texts), starts and ends of words in the joined buffer, and the
    offset of each text there."""
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    s, e, h = scan(b" ".join(t or b"" for t in texts))
    return h, np.searchsorted(s, at), s, e, at


_ROLL = [np.uint64(pow(0xA0761D6478BD642F, i + 1, 1 << 64) | 1) for i in range(8)]


def shingle_sets(texts: list[bytes | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; a text
    with fewer words has its whole sequence as one, one without words none."""
    h, first, *_ = hash_words(texts)
    n = len(h)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        rolled += h[i : i + len(rolled)] * _ROLL[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(spans(h[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
