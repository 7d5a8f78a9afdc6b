"""Quality classifier from weak labels.

1. Overlapping heuristics vote good, bad or nothing on every document.
2. Expectation-maximisation over the counts of vote patterns (at most 3 ** m of
   them, whatever the corpus) estimates the prior and each labeller's chance of
   each vote for either class, and so the posterior of every pattern.
3. Posteriors label a sample of at most about ``SAMPLE`` documents and about
   ``SAMPLE_WORDS`` words, which trains
   a logistic scorer over hashed features: word shapes, pairs of shapes and
   binned statistics.  The sample is the one thing here that doesn't cover all
   documents; its bound is this parameter.
4. The scorer judges every document, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

SAMPLE, SAMPLE_WORDS = 10_000, 8_000_000
BUCKETS = 1 << 14
ROUNDS, RATE, PENALTY = 400, 0.5, 1e-5

#: (name of the statistic, bad from, good up to, the least words to vote bad on)
LABELLERS = (
    ("symbol_words", 0.20, 0.03, 1),
    ("upper_share", 0.50, 0.20, 4),
    ("same_as_before", 0.20, 0.03, 1),
    ("few_distinct", 0.80, 0.60, 100),
    ("bare_marks", 0.10, 0.02, 1),
    ("other_bytes", 0.25, 0.10, 12),
    ("doubled_marks", 0.15, 0.02, 1),
    ("long_words", 0.15, 0.03, 1),
)
STATISTICS = tuple(x[0] for x in LABELLERS)
_FROM, _UP_TO, _LEAST = (np.array([x[i] for x in LABELLERS]) for i in (1, 2, 3))

# classes of bytes: 0 letters (lower case, or beyond ASCII), 1 upper case, 2 digits, 3 usual marks, 4 others
_CLASS = np.full(256, 4, np.uint8)
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:'\"()-?!"]] = 3
# for shapes: letters fall together by case, digits too, marks stay themselves
_SHAPE = np.arange(256, dtype=np.uint64) + np.uint64(1000)
_SHAPE[_CLASS == 0] = 1
_SHAPE[_CLASS == 1] = 2
_SHAPE[_CLASS == 2] = 3
_SHAPE = words.mix(_SHAPE)


class Features:
    """Of several texts: words of each, statistics, votes and hashed features."""

    def __init__(self, texts: list[bytes | None]):
        h, first, s, e, _ = words.hash_words(texts)
        data = np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8)
        self.n = n = np.diff(first)
        self.first = first
        m = len(h)
        doc = np.repeat(np.arange(len(texts)), n)
        kind = _CLASS[data]

        def within(flags: np.ndarray) -> np.ndarray:
            """How many flagged bytes each word has."""
            total = np.zeros(len(data) + 1, np.int32)
            np.cumsum(flags, out=total[1:])
            return total[e] - total[s]

        per = lambda x: np.bincount(doc, weights=x, minlength=len(texts))
        letters = within(kind <= 1)
        upper, other, mark = within(kind == 1), within(kind == 4), within(kind == 3)
        size = e - s
        before = np.zeros(m, bool)
        before[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        pairs = np.zeros(len(data) + 1, np.int32)
        if len(data):
            same = np.zeros(len(data), bool)
            same[1:] = (data[1:] == data[:-1]) & (kind[1:] >= 3)
            np.cumsum(same, out=pairs[1:])
        doubled = pairs[e] - pairs[np.minimum(s + 1, e)] > 0 if m else np.zeros(0, bool)
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:])]) if len(texts) else np.zeros(0)
        one = np.maximum(n, 1)
        self.stats = np.stack(
            [
                per(other > 0) / one,
                per(upper) / np.maximum(per(letters), 1),
                per(before) / one,
                # long texts repeat words; measured against what a text of its size tends to have
                1 - distinct / np.maximum(1, np.minimum(one, 2.5 * np.sqrt(one) * 4)),
                per((letters == 0) & (mark + other == size)) / one,
                per(other + mark) / np.maximum(per(size), 1),
                per(doubled) / one,
                per(size > 30) / one,
            ],
            axis=1,
        )
        self.votes = np.where(self.stats >= _FROM, -1, np.where(self.stats <= _UP_TO, 1, 0))
        self.votes[n[:, None] < _LEAST] = 0  # too short to tell
        # shapes: runs of equal classes count once
        shape = _SHAPE[data]
        starts = np.zeros(len(data), bool)
        if len(data):
            starts[1:] = shape[1:] != shape[:-1]
            starts[s] = True
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(starts, out=at[1:])
        kept = shape[starts]
        word = words.spans(kept, at[s], at[e]) if m else np.zeros(0, np.uint64)
        previous = np.roll(word, 1)
        previous[first[:-1][n > 0]] = np.uint64(77)
        pair = words.mix(word * np.uint64(3) + previous * np.uint64(5) + before.astype(np.uint64))
        self.word = (word % np.uint64(BUCKETS)).astype(np.int64)
        self.pair = (pair % np.uint64(BUCKETS)).astype(np.int64)
        bins = np.floor(np.clip(self.stats, 0, 0.999) * 20).astype(np.uint64)
        named = bins + (np.arange(len(LABELLERS), dtype=np.uint64) + np.uint64(1)) * np.uint64(1000)
        self.bins = (words.mix(named) % np.uint64(BUCKETS)).astype(np.int64)
        self.doc = doc

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Log odds of good quality."""
        one = np.maximum(self.n, 1)
        total = np.bincount(self.doc, weights=weights[self.word] + weights[self.pair], minlength=len(self.n)) / one
        return weights[BUCKETS] + total + weights[self.bins].sum(1)

    def sparse(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[i], self.first[i + 1]
        index = np.concatenate([self.word[a:b], self.pair[a:b], self.bins[i]])
        value = np.concatenate([np.full(2 * (b - a), 1 / max(1, b - a)), np.ones(len(LABELLERS))])
        used, inverse = np.unique(index, return_inverse=True)
        return used, np.bincount(inverse, weights=value)


def _codes(votes: np.ndarray) -> np.ndarray:
    return ((votes + 1) * 3 ** np.arange(votes.shape[1])).sum(1).astype(np.int64)


def votes_of(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[Features]:
    shared.trim()
    for batch in batches:
        texts = shared.texts_of(batch)
        for a, b in words.batches(texts):
            yield Features(texts[a:b])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, words_ = np.zeros(3 ** len(LABELLERS), np.int64), np.zeros(3 ** len(LABELLERS))
    for f in _features(batches):
        codes = _codes(f.votes[f.n > 0])
        total += np.bincount(codes, minlength=len(total))
        words_ += np.bincount(codes, weights=f.n[f.n > 0], minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used]), pa.array(words_[used].astype(np.int64))], names=["pattern", "n", "words"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in _features(batches):
        rows = [i for i in range(len(f.n)) if f.n[i]]
        parts = [f.sparse(i) for i in rows]
        yield pa.RecordBatch.from_arrays([pa.array(_codes(f.votes)[rows]), pa.array([p[0] for p in parts], pa.list_(pa.int64())), pa.array([p[1] for p in parts], pa.list_(pa.float64()))], names=["pattern", "index", "value"])


def accuracies(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior chance of good for each pattern; chance[class, labeller, vote + 1]
    of each vote; prior chance of good.

    Class 0 is good.  Bad texts are bad in different ways, and a labeller sees one
    of them, so there is a bad class for each labeller, which starts with the
    patterns in which it alone, or with others, votes bad.  Every class estimates
    the accuracy of every labeller.
    """
    votes = votes_of(codes)
    m = votes.shape[1]
    bad = votes < 0
    share = np.zeros((m + 1, len(codes)))
    share[1:] = (bad / np.maximum(1, bad.sum(1))[:, None]).T
    share[0] = ~bad.any(1)
    share = 0.98 * share + 0.02 / (m + 1)
    chance = np.zeros((m + 1, m, 3))
    for _ in range(rounds):
        old = share
        weight = counts * share
        prior = (weight.sum(1) + 0.1) / (counts.sum() + 0.1 * (m + 1))
        for v in (-1, 0, 1):
            chance[:, :, v + 1] = weight @ (votes == v) + 0.1
        chance /= chance.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.stack([np.log(chance[c, np.arange(m), votes + 1]).sum(1) for c in range(m + 1)])
        share = np.exp(log - log.max(0, initial=-np.inf))
        share /= share.sum(0)
        if np.abs(share - old).max(initial=0) < 1e-9:
            break
    return share[0], chance, float(prior[0])


def train(index: list[np.ndarray], value: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Weights of BUCKETS features and the bias, by full-batch AdaGrad."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    if not len(good):
        return w
    row = np.repeat(np.arange(len(good)), [len(x) for x in index])
    flat, x = np.concatenate(index), np.concatenate(value)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(w[BUCKETS] + np.bincount(row, weights=w[flat] * x, minlength=len(good)), -40, 40)))
        error = (p - good) / len(good)
        slope = np.append(np.bincount(flat, weights=error[row] * x, minlength=BUCKETS), error.sum())
        slope[:BUCKETS] += PENALTY * w[:BUCKETS]
        seen += slope * slope
        w -= RATE * slope / np.sqrt(seen)
    return w


class Model:
    def __init__(self, weights: np.ndarray, posterior: dict[int, float], chance: np.ndarray, prior: float):
        self.weights, self.posterior, self.chance, self.prior = weights, posterior, chance, prior


def fit(docs: DataFrame) -> Model:
    """Estimate labellers on all documents and train the scorer on the sample."""
    spark = docs.sparkSession
    with shared.small_batches(spark):
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        rows = texts.select("text").mapInArrow(_patterns, "pattern long, n long, words long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).orderBy("pattern").collect()
        codes, counts = np.array([r["pattern"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)
        good, chance, prior = accuracies(codes, counts) if len(rows) else (np.zeros(0), np.zeros((len(LABELLERS) + 1, len(LABELLERS), 3)), 0.5)
        posterior = dict(zip(codes.tolist(), good.tolist()))
        span = 1 << 40
        # in a word's features as well as in documents: what comes to the driver is bounded
        whole = max(1.0, float(sum(r["words"] for r in rows)))
        share = min(span, int(np.ceil(span * min(SAMPLE / max(1.0, counts.sum()), SAMPLE_WORDS / whole))))
        # by id and text, so that rows without an id are sampled like others
        sample = texts.where(F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(span)) < share).select("text")
        index, value, labels = [], [], []
        for r in sample.mapInArrow(_examples, "pattern long, index array<long>, value array<double>").toLocalIterator():
            index.append(np.array(r["index"], np.int64))
            value.append(np.array(r["value"]))
            labels.append(posterior.get(r["pattern"], prior))
    return Model(train(index, value, np.array(labels)), posterior, chance, prior)


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_words, posterior (of the document's votes), score (the scorer's
    chance of good quality, to 6 places) and kept (score >= 0.5).

    A row for each row, null ids included; every whole text is read.  A null text
    or one without words has no votes, a score of 0 and is not kept.  Labels are
    not read: the fit rests on the heuristics alone.  An empty table gives an
    empty result.  Other columns are not read.
    """
    model = model or fit(docs)
    weights, posterior, prior = model.weights, model.posterior, model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.trim()
        for batch in shared.small(batches):
            texts = shared.texts_of(batch)
            for a, b in words.batches(texts):
                f = Features(texts[a:b])
                p = np.where(f.n > 0, np.round(1 / (1 + np.exp(-np.clip(f.scores(weights), -40, 40))), 6), 0.0)
                post = [round(posterior.get(c, prior), 6) if n else None for c, n in zip(_codes(f.votes).tolist(), f.n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(f.n), pa.array(post, pa.float64()), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "n_words", "posterior", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they are.
    Null texts and texts without words go; rows with a null id and repeated rows are
    judged like any other; an empty table stays empty."""
    weights = (model or fit(docs)).weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.trim()
        for batch in shared.small(batches):
            texts = shared.texts_of(batch)
            for a, b in words.batches(texts):
                f = Features(texts[a:b])
                p = np.round(1 / (1 + np.exp(-np.clip(f.scores(weights), -40, 40))), 6)
                yield batch.slice(a, b - a).filter(pa.array((f.n > 0) & (p >= 0.5)))

    return docs.mapInArrow(run, docs.schema)
