"""Canonical, length-limited Huffman codes over token ids, as numpy arrays."""

from __future__ import annotations

import numpy as np

LIMIT = 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids
    that don't occur.  A single id gets one bit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(order) - 2
    lengths = np.zeros(len(order), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        code <<= 1
        codes[own] = np.arange(code, code + len(own))
        code += len(own)
    return codes


def table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``bits`` bits, the id and its code length."""
    bits = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    times = 1 << (bits - lengths[order].astype(np.int64))
    ids = np.zeros(1 << bits, np.uint32)
    own = np.repeat(order, times)
    ids[: len(own)] = own
    return ids, lengths[ids].astype(np.int64), bits


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of ids as big-endian 64-bit words (one spare at the end), and the
    bit offset of each id and of the end."""
    n = lengths[ids].astype(np.int64)
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    words = np.zeros((int(at[-1]) >> 6) + 2, np.uint64)
    if not len(ids):
        return words, at
    code = codes[ids]
    word, end = at[:-1] >> 6, (at[:-1] & 63) + n
    fits = end <= 64
    first = np.where(fits, code << (64 - np.minimum(end, 64)).astype(np.uint64), code >> np.maximum(end - 64, 0).astype(np.uint64))
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[heads]] = np.add.reduceat(first, heads)
    over = np.flatnonzero(~fits)
    words[word[over] + 1] += code[over] << (128 - end[over]).astype(np.uint64)
    return words, at


def decode(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of independent blocks, each from its bit offset, in step."""
    ids, sizes, bits = table(lengths)
    at = starts.astype(np.int64).copy()
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    out = np.empty(int(first[-1]), np.uint32)
    shift = np.uint64(64 - bits)
    live = np.arange(len(counts))
    step = 0
    while True:
        if (counts[live] <= step).any():
            live = live[counts[live] > step]
        if not len(live):
            return out
        a = at[live]
        w = a >> 6
        r = (a & 63).astype(np.uint64)
        # a shift by 64 is undefined, so the second word is shifted in two steps
        peek = ((words[w] << r) | ((words[w + 1] >> np.uint64(1)) >> (np.uint64(63) - r))) >> shift
        out[first[live] + step] = ids[peek]
        at[live] = a + sizes[peek]
        step += 1
