"""SentencePiece encoding and decoding, and sampled segmentations by perturbed
A-star search.

Encoding.  A text falls apart between two characters that stand side by side in
no piece.  Its chunks are encoded, and have their lattices, on their own; equal
chunks share that work.

Sampling.  A piece of rank r has weight (r + 2.7) ** -SHARPNESS, a segmentation
the product of its pieces' weights.  Backward sums over the lattice turn weights
into the chance of each next piece.  The Gumbel-perturbed log chance of a whole
set of segmentations is one Gumbel variable at its log mass, so a set is a node
of an A-star search: the best node is popped, its best member is drawn by
following the lattice, and what is left of the node is split where it first
differs from that member, each part with a Gumbel truncated at its parent's.
The first k members drawn are the Gumbel top-k: a sample without replacement.
All chance is hashed from the row's key, so it depends on nothing else.

A part whose mass is below 2 ** -66 of the whole is beneath the precision of a
double and is not tracked.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

SHARPNESS = 0.35
SAMPLES = 2
BATCH = 1 << 18
LONGEST = 16
#: Edges of remembered lattices, of 24 bytes each.
KNOWN_EDGES = 2_500_000
_FAINT = -46.0
_MARK = 0x2581
_WIDTH = 192


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.text[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        low = self.plain[0] if self.plain else 0
        self.score = np.full(n, 0.0)
        ranks = np.array(self.plain) - low
        self.score[self.plain] = -SHARPNESS * np.log(ranks + 2.7)
        self.byte_score = -SHARPNESS * math.log(len(self.plain) + 2.7)
        self.raw = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(self.text[i][1:-1], 16)]) if sp.is_byte(i) else self.text[i].replace("▁", " ").encode() for i in range(n)]
        self.raw_size = np.array([len(x) for x in self.raw])
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.longest = min(LONGEST, max((len(self.text[i]) for i in self.plain), default=1))
        # pieces by the hash of their code points, a filter of 2 ** 20 bits ahead
        cps = [np.array([ord(c) for c in self.text[i]], np.uint64) for i in self.plain]
        flat = np.concatenate(cps) if cps else np.zeros(0, np.uint64)
        end = np.cumsum([len(c) for c in cps])
        h = words.spans(words.mix(flat), end - [len(c) for c in cps], end)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array(self.plain)[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.singles = {self.text[i] for i in self.plain if len(self.text[i]) == 1}
        # which characters stand side by side in a piece; class 0 joins nothing
        pairs = {x + y for i in self.plain for x, y in zip(self.text[i], self.text[i][1:])}
        letters = sorted({c for p in pairs for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.kinds = len(letters) + 1
        self.joined = np.zeros(self.kinds * self.kinds, bool)
        for x, y in pairs:
            self.joined[self.kind[ord(x)] * self.kinds + self.kind[ord(y)]] = True
        self.mixed = words.mix(np.arange(0x110000, dtype=np.uint64))
        # a chunk without a space mark is encoded behind a character that joins nothing
        self.guard = next(c for c in "\n\t\x01" if not self.kind[ord(c)])
        self.guard_size = len(sp.encode(self.guard))


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[first:first + size] numbered ``at``, joined, and their ends."""
    n = size[at]
    ends = np.cumsum(n)
    if not len(at) or not ends[-1]:
        return flat[:0], ends
    return flat[np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1])], ends


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """Lattices of some chunks, given as code points and sizes: a state for every
    position, its edges ordered by their chance, each with its cumulated chance,
    piece and next state."""

    def __init__(self, v: Vocabulary, cp: np.ndarray, size: np.ndarray):
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        total = len(cp)
        far = np.repeat(at[1:], size) - np.arange(total)
        # states are numbered by their distance from the end of their chunk, so
        # the edges of each distance lie together, and so do those of a state
        place = np.argsort(far.astype(np.uint16) if total and far.max() < 1 << 16 else far, kind="stable")
        far = far[place]
        rank = np.empty(total + 1, np.int64)
        rank[place] = np.arange(total)
        # hashes of runs as words.spans has them, their sums made once
        base, inverse = words.powers(words._BASE, total), words.powers(words._INVERSE, total + 1)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(v.mixed[cp] * base, out=sums[1:])
        from_here, shift = sums[place], inverse[place]
        src, length, piece = [], [], []
        for n in range(v.longest, 0, -1):
            i = np.searchsorted(far, n)
            if i == total:
                continue
            h = (sums[place[i:] + n] - from_here[i:]) * shift[i:]
            h = words.mix(h ^ np.uint64(n * words._SIZE & words._MASK))
            maybe = np.flatnonzero(v.filter[(h >> np.uint64(44)).astype(np.int64)])
            h = h[maybe]
            j = np.minimum(np.searchsorted(v.hashes, h), len(v.hashes) - 1)
            real = v.hashes[j] == h
            src.append(maybe[real] + i)
            length.append(np.full(len(src[-1]), n))
            piece.append(v.ids[j[real]])
        src, length, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (src, length, piece))
        single = np.zeros(total, bool)
        single[src[length == 1]] = True
        bare = np.flatnonzero(~single)  # these fall back to bytes: -1 - code point
        code = cp[place[bare]]
        octets = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)
        score = np.concatenate([v.score[piece], octets * v.byte_score])
        src = np.concatenate([src, bare])
        piece = np.concatenate([piece, -1 - code.astype(np.int64)])
        length = np.concatenate([length, np.ones(len(bare), np.int64)])
        order = np.argsort(src, kind="stable")
        src, piece, length, score = src[order], piece[order], length[order], score[order]
        done = far[src] == length
        follow = np.where(done, -1, rank[np.minimum(place[src] + length, total - 1)] if total else 0)
        self.first = np.searchsorted(src, np.arange(total + 1))
        cuts = self.first[np.searchsorted(far, np.arange(1, int(size.max(initial=0)) + 2))]
        back = np.zeros(total + 1)
        value = score
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            value[a:b] += np.where(done[a:b], 0.0, back[follow[a:b]])
            lo, hi = int(src[a]), int(src[b - 1]) + 1
            back[lo:hi] = np.logaddexp.reduceat(value[a:b], self.first[lo:hi] - a)
        self.log = value - back[src]
        self.piece, self.next = piece.astype(np.int32), follow
        p = np.exp(self.log)
        cum = np.cumsum(p)
        if len(p):
            heads = self.first[:-1]
            cum -= np.repeat(cum[heads] - p[heads], np.diff(self.first))
            cum[self.first[1:] - 1] = 2.0  # the last edge takes what rounding left
        self.cum = cum
        self.start = rank[at[:-1]]


class Store:
    """Lattices one after another, with the ids of their chunks; what lies above
    a mark is overwritten."""

    FIELDS = {"log": np.float64, "cum": np.float64, "piece": np.int32, "next": np.int32, "first": np.int32, "start": np.int32, "code": np.uint16, "code_first": np.int64, "code_size": np.int32}

    def __init__(self):
        self.size = dict.fromkeys(self.FIELDS, 0)
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.zeros(1024, kind))

    def _put(self, name: str, values: np.ndarray) -> None:
        have, n = getattr(self, name), self.size[name]
        if n + len(values) > len(have):
            more = np.zeros(max(n + len(values), len(have) * 3 // 2), have.dtype)
            more[:n] = have[:n]
            setattr(self, name, have := more)
        have[n : n + len(values)] = values
        self.size[name] = n + len(values)

    def add(self, x: Lattices, codes: np.ndarray, size: np.ndarray) -> None:
        edges, states, ids = self.size["log"], self.size["first"], self.size["code"]
        self._put("next", np.where(x.next < 0, -1, x.next + states))
        self._put("first", x.first[:-1] + edges)
        self._put("start", x.start + states)
        for name in ("log", "cum", "piece"):
            self._put(name, getattr(x, name))
        self._put("code", codes)
        self._put("code_first", ids + np.cumsum(size) - size)
        self._put("code_size", size)

    def walk(self, state: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follow each walker from its state to the end of its chunk: edges, walker
        after walker, and how many each has."""
        n = len(state)
        taken, who, live, at, step = [], [], np.arange(n), state.astype(np.int64), 0
        count = np.zeros(n, np.int64)
        while len(live):
            u = uniform(seed[live] + np.uint64(step))
            edge = self.first[at].astype(np.int64)
            more = np.flatnonzero(self.cum[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[self.cum[edge[more]] <= u[more]]
            taken.append(edge)
            who.append(live)
            count[live] += 1
            at = self.next[edge]
            on = np.flatnonzero(at >= 0)
            live, at = live[on], at[on]
            step += 1
        offset = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for r, (e, w) in enumerate(zip(taken, who)):
            out[offset[w] + r] = e
        return out, count


def uniform(seed: np.ndarray) -> np.ndarray:
    return ((words.mix(seed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def uniform1(seed: int) -> float:
    """``uniform`` of one seed."""
    x = seed * 0x9E3779B97F4A7C15 & words._MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & words._MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & words._MASK
    return (((x ^ x >> 31) >> 11) + 0.5) / (1 << 53)


def gumbel(u: float) -> float:
    return -math.log(-math.log(u))


def truncated(mass: float, top: float, u: float) -> float:
    """A Gumbel at location ``mass``, given that it is at most ``top``."""
    g = mass + gumbel(u)
    a, b = -top, -g
    m = max(a, b)
    return -(m + math.log(math.exp(a - m) + math.exp(b - m)))


class Known:
    """Numbers of chunks by hash: open addresses, looked up many at a time."""

    def __init__(self, bits: int = 20):
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.zeros(1 << bits, np.int32)
        self.n = 0

    def full(self) -> bool:
        return self.n * 4 > len(self.keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        left, at = np.arange(len(h)), h.astype(np.int64) & self.mask
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.numbers[at[hit]]
            on = np.flatnonzero(~hit & (k != 0))
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, first: int) -> None:
        """Distinct new hashes, numbered from ``first`` on."""
        number, at = np.arange(first, first + len(h)), h.astype(np.int64) & self.mask
        self.n += len(h)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]], self.numbers[at[free]] = h[free], number[free]
            on = np.flatnonzero(self.keys[at] != h)
            h, number, at = h[on], number[on], (at[on] + 1) & self.mask


class Coder:
    """Encodes texts and samples segmentations.  Remembers chunks that came twice
    in one batch, with their lattices, up to KNOWN_EDGES edges."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known, self.store = Known(), Store()

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and how many each chunk has."""
        mark, guard, skip = self.v.sp.piece_to_id("▁"), self.v.guard, self.v.guard_size
        # the library marks a space ahead of every text but an empty one
        sent = [c[1:] if c[0] == "▁" else guard + c for c in chunks]
        ids = [(x or [mark]) if c[0] == "▁" else x[skip:] for c, x in zip(chunks, self.v.sp.encode(sent, num_threads=1))]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint16, int(size.sum())), size

    def _learn(self, cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Adds the chunks cp[start:start + size] to the store."""
        own, ends = gather(cp, starts, sizes, np.arange(len(starts)))
        text, ends = own.tobytes().decode("utf-32-le"), ends.tolist()
        codes, size = self._encode([text[a:b] for a, b in zip([0, *ends[:-1]], ends)])
        self.store.add(Lattices(self.v, own, sizes), codes, size)

    def prepare(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Chunk numbers of all texts, the offset of each text's first, and ids of
        each text.  The store holds the chunks until the next call."""
        v, store = self.v, self.store
        size = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        cp = np.frombuffer("".join("▁" + t for t in texts if t).encode("utf-32-le"), np.uint32)
        cp = np.where(cp == 32, np.uint32(_MARK), cp)
        kind = v.kind[cp]
        cut = np.ones(len(cp), bool)
        cut[1:] = ~v.joined[kind[:-1] * v.kinds + kind[1:]]
        text_at = np.cumsum(size) - size
        cut[text_at[size > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(cp)) if len(starts) else starts
        h = words.spans(v.mixed[cp], starts, ends) | np.uint64(1)
        numbers = self.known.find(h)
        base = store.size["start"]
        mark = dict(store.size)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, at, which, times = np.unique(h[missing], return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(times == 1, kind="stable")  # those to be remembered first
            often = int((times > 1).sum()) if store.size["log"] < KNOWN_EDGES and not self.known.full() else 0
            at, rank = missing[at[order]], np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            numbers[missing] = base + rank[which]
            if often:
                self._learn(cp, starts[at[:often]], (ends - starts)[at[:often]])
                self.known.add(new[order[:often]], base)
                mark = dict(store.size)
            if often < len(at):
                self._learn(cp, starts[at[often:]], (ends - starts)[at[often:]])
        store.size = mark  # the next call overwrites what isn't remembered
        offset = np.searchsorted(starts, np.append(text_at, len(cp)))
        ids, ends = gather(store.code, store.code_first, store.code_size, numbers)
        ends = np.concatenate([[0], ends])[offset]
        return numbers, offset, [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of rows of ids, joined in ``flat``; the one space that encoding
        put first is left out (a text that starts with a line feed has it too)."""
        out, ends = gather(self.v.raw_flat, self.v.raw_first, self.v.raw_size, flat)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        raw = out.tobytes()
        return [raw[a + 1 : b] for a, b in zip(ends[:-1], ends[1:])]


@cache
def _coder(path: str) -> Coder:
    """One a worker process: later tasks find the chunks of earlier ones."""
    return Coder(path)


class Sampler:
    """The top-k search over the texts of one batch."""

    def __init__(self, coder: Coder, prepared, keys: np.ndarray):
        self.coder, self.store = coder, coder.store
        self.chunks, self.offset, _ = prepared
        self.keys = keys
        self.key = keys.tolist()

    def seeds(self, sample: int) -> np.ndarray:
        """Of each text."""
        return words.mix(self.keys + np.uint64((sample + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))

    def top(self, k: int) -> list[list[dict]]:
        """For each text its samples in order: edges, log chance and perturbed
        value, and the value of the best segmentation left out."""
        docs = len(self.offset) - 1
        none = np.zeros(0, np.int64)
        out: list[list[dict]] = [[] for _ in range(docs)]
        heaps: list[list] = [[] for _ in range(docs)]
        # where each text's next sample starts anew: word, state there, edges and
        # ends of words before, their log, the value and what the node has shut
        todo = [(i, 0, -1, none, none, 0.0, gumbel(uniform1(self.key[i])), None) for i in range(docs)]
        for sample in range(k):
            if not todo:
                break
            doc = np.array([x[0] for x in todo])
            skip = np.array([x[1] for x in todo])
            span = self.offset[doc + 1] - self.offset[doc] - skip
            ends = np.cumsum(span)
            word = np.arange(int(ends[-1])) - np.repeat(ends - span - skip, span)
            state = self.store.start[self.chunks[np.repeat(self.offset[doc], span) + word]]
            inside = np.array([x[2] for x in todo])
            mid = np.flatnonzero((inside >= 0) & (span > 0))
            state[(ends - span)[mid]] = inside[mid]
            seed = np.repeat(self.seeds(sample)[doc], span) + word.astype(np.uint64) * np.uint64(1 << 24)
            edges, count = self.store.walk(state, seed)
            logs = self.store.log[edges]
            total = np.zeros(len(count) + 1, np.int64)
            np.cumsum(count, out=total[1:])
            first, last = total[ends - span], total[ends]
            sums = np.zeros(len(todo))
            full = np.flatnonzero(last > first)
            if len(full):
                sums[full] = np.add.reduceat(logs, first[full])
            paths = []
            for (i, w, _, before, before_ends, before_log, value, _), a, b, x, y, s in zip(todo, (ends - span).tolist(), ends.tolist(), first.tolist(), last.tolist(), sums.tolist()):
                e, n = edges[x:y], total[a + 1 : b + 1] - x
                paths.append((np.concatenate([before, e]), np.concatenate([before_ends, len(before) + n])) if len(before) else (e, n))
                out[i].append({"edges": paths[-1][0], "log": before_log + s, "value": value})
            self._split(heaps, todo, paths, sample, k - sample, logs, first, last)
            todo = [self._pop(heaps[i], i, sample + 1) for i in range(docs) if heaps[i]] if sample + 1 < k else []
        for i in range(docs):
            left = -heaps[i][0][0] if heaps[i] else -math.inf
            for x in out[i]:
                x["threshold"] = left
        return out

    def _split(self, heaps, todo, paths, sample, keep, logs, first, last) -> None:
        """Push what is left of the nodes once their paths have been drawn; of a
        node's parts the ``keep`` best, as no more are ever popped."""
        for (i, *_, value, barred), (path, ends) in zip(todo, paths):
            if barred is None:
                continue
            step, shut, ahead = barred
            shut = shut | {int(path[step])}
            gone = math.fsum(math.exp(self.store.log[x]) for x in sorted(shut))
            if gone < 1 - 1e-13:
                mass = ahead + math.log1p(-gone)
                if mass >= _FAINT:
                    u = uniform1(self.key[i] ^ (sample + 1) << 40 ^ len(shut) << 32)
                    heapq.heappush(heaps[i], (-truncated(mass, value, u), sample, step, tuple(sorted(shut)), ahead, path, ends))
        n, rows, width = last - first, np.arange(len(todo)), _WIDTH
        while len(rows):  # chances ahead fall off fast: few rows need a greater width
            at = first[rows, None] + np.arange(min(width, int(n[rows].max())))
            real = at < last[rows, None]
            part = np.where(real, logs[np.minimum(at, max(len(logs) - 1, 0))] if len(logs) else 0.0, 0.0)
            known_log = np.array([todo[r][5] for r in rows])
            ahead = known_log[:, None] + np.cumsum(part, axis=1) - part
            over = (n[rows] > width) & (ahead[:, -1] >= _FAINT) if part.shape[1] else np.zeros(len(rows), bool)
            value = np.array([todo[r][6] for r in rows])
            key = self.keys[[todo[r][0] for r in rows]] ^ np.uint64((sample + 1) << 40)
            r, c = np.nonzero(real & (part < -1e-13) & (ahead >= _FAINT) & ~over[:, None])
            g = np.full(part.shape, -np.inf)
            mass = ahead[r, c] + np.log(-np.expm1(part[r, c]))
            x = mass - np.log(-np.log(uniform(key[r] + c.astype(np.uint64) + np.uint64(1))))
            g[r, c] = -np.logaddexp(-value[r], -x)
            for _ in range(min(keep, part.shape[1])):
                best = g.argmax(axis=1)
                top = g[np.arange(len(rows)), best]
                for r in np.flatnonzero(top > -np.inf).tolist():
                    i, c, before = todo[rows[r]][0], int(best[r]), len(todo[rows[r]][3])
                    path, ends = paths[rows[r]]
                    heapq.heappush(heaps[i], (-float(top[r]), sample, before + c, (int(path[before + c]),), float(ahead[r, c]), path, ends))
                g[np.arange(len(rows)), best] = -np.inf
            rows, width = rows[over], width * 8

    def _pop(self, heap, i, sample):
        value, _, step, shut, ahead, path, ends = heapq.heappop(heap)
        store = self.store
        edge = int(path[step])
        # the edges of the state that step leaves: the last of a state has its chance above 1
        lo = hi = edge
        while lo and store.cum[lo - 1] < 1.5:
            lo -= 1
        while store.cum[hi] < 1.5:
            hi += 1
        free = [e for e in range(lo, hi + 1) if e not in shut]
        p = [math.exp(store.log[e]) for e in free]
        rest = uniform1(self.key[i] ^ (sample << 40) + (1 << 39) + step) * math.fsum(p)
        pick = free[-1]
        for e, x in zip(free, p):
            if rest < x:
                pick = e
                break
            rest -= x
        w = int(np.searchsorted(ends, step, "right"))
        before, log, follow = np.append(path[:step], pick), ahead + float(store.log[pick]), int(store.next[pick])
        barred = (step, set(shut), ahead)
        if follow < 0:
            return (i, w + 1, -1, before, np.append(ends[:w], step + 1), log, -value, barred)
        return (i, w, follow, before, ends[:w], log, -value, barred)

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Pieces of edges; those that fall back become their bytes' pieces."""
        return self.ids_of([edges])[0]

    def ids_of(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of several rows of edges, joined, and how many each row has."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        p = self.store.piece[np.concatenate(rows)].astype(np.int64) if rows else np.zeros(0, np.int64)
        low = np.flatnonzero(p < 0)
        if not len(low):
            return p, sizes
        codes, which = np.unique(-1 - p[low], return_inverse=True)
        octets = [chr(c).encode() for c in codes.tolist()]
        width = np.array([len(o) for o in octets])
        table = np.array([[self.coder.v.bytes[o[min(j, len(o) - 1)]] for j in range(4)] for o in octets])
        size = np.ones(len(p), np.int64)
        size[low] = width[which]
        first = np.cumsum(size) - size
        out = np.repeat(p, size)
        for j in range(int(width.max())):
            own = width[which] > j
            out[first[low[own]] + j] = table[which[own], j]
        whole = np.concatenate([first, [len(out)]])[np.concatenate([[0], np.cumsum(sizes)])]
        return out, np.diff(whole)


def _inclusion(log: float, threshold: float) -> float:
    """Log chance that a segmentation of this log chance beats the threshold."""
    if threshold == -math.inf:
        return 0.0
    x = log - threshold
    if x < -30:
        return x
    return math.log(-math.expm1(-math.exp(min(x, 700))))


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, decoded boolean, samples array<struct<n_pieces:long,ids_crc32:long,log_prob:double,value:double,log_inclusion:double,decoded:boolean>>"


def _crcs(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    data, ends = memoryview(flat.astype("<u4").tobytes()), (4 * np.cumsum(sizes)).tolist()
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip([0, *ends[:-1]], ends)], pa.int64())


def _offsets(rows: list) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.astype(np.int32)))


def _segment(path: str, k: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.trim()
        coder = _coder(path)
        for batch in shared.small(batches, limit=BATCH):
            texts, keys = shared.texts_of(batch), batch.column("key").to_numpy().view(np.uint64)
            for a, b in words.batches(texts, BATCH):
                plain = [(t or b"").decode("utf-8").replace("▁", " ") for t in texts[a:b]]
                prepared = coder.prepare(plain)
                sampler = Sampler(coder, prepared, words.mix(keys[a:b].copy()))
                drawn = sampler.top(k)
                flat, encoded = [x for row in drawn for x in row], prepared[2]
                own, own_size = sampler.ids_of([x["edges"] for x in flat])
                size = np.fromiter(map(len, encoded), np.int64, len(encoded))
                first = np.concatenate(encoded).astype(np.int64) if encoded else np.zeros(0, np.int64)
                want = [t.encode() for t in plain]
                ok = [x == w for x, w in zip(coder.decode(first, size), want)]
                ok_own = [x == w for x, w in zip(coder.decode(own, own_size), (w for w, row in zip(want, drawn) for _ in row))]
                found = {"n_pieces": pa.array(own_size, pa.int64()), "ids_crc32": _crcs(own, own_size)}
                found |= {name: pa.array([x[key] for x in flat], pa.float64()) for name, key in (("log_prob", "log"), ("value", "value"))}
                found |= {"log_inclusion": pa.array([_inclusion(x["log"], x["threshold"]) for x in flat], pa.float64()), "decoded": pa.array(ok_own, pa.bool_())}
                columns = {"doc_id": batch.column("doc_id").slice(a, b - a), "n_pieces": pa.array(size, pa.int64()), "ids_crc32": _crcs(first, size), "decoded": pa.array(ok, pa.bool_())}
                if with_ids:
                    found["ids"], columns["ids"] = _lists(own, own_size), _lists(first, size)
                columns["samples"] = pa.ListArray.from_arrays(_offsets(drawn), pa.StructArray.from_arrays(list(found.values()), list(found)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def segmentations(docs: DataFrame, model: str | None = None, k: int = SAMPLES, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The encoding of every whole text and k sampled segmentations.

    Rows: doc_id, n_pieces and ids_crc32 (of the ids as little-endian 32-bit
    integers) of the model's own encoding, decoded (whether its decoding is the
    text again) and samples, in the order of their perturbed values: n_pieces,
    ids_crc32, log_prob (of the segmentation), value (perturbed), log_inclusion
    (log chance of being above the best value left out, 0 if none is left) and
    decoded.  Both also hold the ids, but without ``with_ids`` only the digests.

    A text with fewer than k segmentations has them all.  Null and empty texts
    have no pieces and one empty segmentation.  The sign U+2581 stands for a
    space, as in the model.  Rows with a null id have their chance from a null
    key; rows repeated under one id get the same segmentations if their texts
    are equal.  An empty table gives an empty
    result.  Other columns are not read, whatever their names.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.lit(8), F.col(id_col).cast("long")).alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA
    if with_ids:
        schema = schema.replace("decoded boolean, samples", "decoded boolean, ids array<int>, samples").replace("decoded:boolean>", "decoded:boolean,ids:array<int>>")
    return rows.mapInArrow(_segment(model, k, with_ids), schema)
