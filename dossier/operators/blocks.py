"""A full-text index of several fields, in blocks that a search can pass over.

Documents are numbered and cut into ranges of ``RANGE``; the postings of a term in one
range are a block: document numbers as differences, how often the term is in each field,
lengths and positions, each packed seven bits a byte into a column of its own.  A block
also has the best score that the term reaches in it.  Ranges are the same for all terms,
so the sum of what the terms' blocks promise bounds every document of a range, a search
scores the most promising ranges first and reads no other that can't reach its kth score.
No task sees a term as a whole, only its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut
from .numbering import numbered
from .search import terms

RANGE = 1024
K1, B = 1.2, 0.75


def _laid(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0, seven bits a byte, low ones first, a set high bit goes on;
    and where the bytes of each end."""
    v = np.asarray(values, np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        on = size > k
        low = (v[on] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[(ends - size)[on] + k] = low | np.where(size[on] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def pack(values: np.ndarray) -> bytes:
    return _laid(values)[0].tobytes()


def _pack_each(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """What ``pack`` makes of the values from each start to the next."""
    data, ends = _laid(values)
    offsets = np.r_[0, ends][np.r_[starts, len(values)]].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(b < 128)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


@dataclass
class Index:
    """blocks: term, range, n, best, docs, counts, lengths, positions; docs: doc_no, id and
    length; how many documents there are, their mean length and the fields' weights."""

    blocks: DataFrame
    docs: DataFrame
    n: int
    mean: float
    weights: list[float]


def _gain(f: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def _heads(rows: pa.Table, size: int) -> np.ndarray:
    """Whether each of the sorted rows (term, doc_no) is the first of a block."""
    term, where = rows.column("term"), rows.column("doc_no").to_numpy() // size
    other = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy()
    return np.r_[True, other | (where[1:] != where[:-1])]


def _blocks(rows: pa.Table, size: int, weight: np.ndarray, mean: float) -> pa.RecordBatch:
    """The blocks of rows (term, doc_no, length, field, place), sorted."""
    doc, length, field, place = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_no", "length", "field", "place"))
    head, width = _heads(rows, size), len(weight)
    new = head | np.r_[True, doc[1:] != doc[:-1]]  # of postings, a document's rows each
    at = np.flatnonzero(new)
    first, starts = np.flatnonzero(head), np.flatnonzero(head[at])
    low, length = doc[at] % size, length[at]
    count = np.bincount((np.cumsum(new) - 1) * width + field, minlength=len(at) * width).reshape(-1, width)
    gap = low - np.where(head[at], 0, np.r_[0, low[:-1]])
    goes_on = ~new & (field == np.r_[-1, field[:-1]])
    step = place - np.where(goes_on, np.r_[0, place[:-1]], 0)
    columns = {
        "term": rows.column("term").take(pa.array(first)).combine_chunks(),
        "range": pa.array(doc[first] // size),
        "n": pa.array(np.diff(np.r_[starts, len(at)])),
        "best": pa.array(np.maximum.reduceat(_gain(count @ weight, length, mean), starts)),
        "docs": _pack_each(gap, starts),
        "counts": _pack_each(count.ravel(), starts * width),
        "lengths": _pack_each(length, starts),
        "positions": _pack_each(step, first),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def build(rows: DataFrame, ident: str, fields: dict[str, float], only: list[str] | None = None, analyze: Callable[[Column], Column] = terms) -> Index:
    """An index of ``fields``, by their weights in a score.  ``only`` leaves other terms
    out of the blocks, but not out of lengths.  Documents without terms count."""
    names, weights = list(fields), list(fields.values())
    docs = numbered(rows.select(F.col(ident).alias("id"), *(analyze(F.col(c)).alias(f"f{i}") for i, c in enumerate(names))), ["id"], "doc_no")
    docs = cut(docs.select((F.col("doc_no") - 1).alias("doc_no"), "id", sum((F.size(f"f{i}") for i in range(len(names))), F.lit(0)).alias("length"), *(f"f{i}" for i in range(len(names)))))
    n, mean = docs.agg(F.count("*"), F.avg("length")).first()
    each = None
    for i in range(len(names)):
        part = docs.select("doc_no", "length", F.lit(i).alias("field"), F.posexplode(f"f{i}").alias("place", "term"))
        each = part if each is None else each.unionAll(part)
    if only is not None:
        each = each.where(F.col("term").isin(only))
    rows = each.select("term", "doc_no", "length", "field", "place").repartition("term", F.expr(f"doc_no div {RANGE}")).sortWithinPartitions("term", "doc_no", "field", "place")
    size, weight, mean = RANGE, np.array(weights), float(mean or 0) or 1.0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last block, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            # one row before the batch tells whether its first one goes on
            ahead = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 1)
            heads = np.flatnonzero(_heads(pa.Table.from_batches([ahead, batch]), size)[1:])
            if len(heads):
                last = int(heads[-1])
                whole = [*held, batch.slice(0, last)]
                if sum(x.num_rows for x in whole):
                    yield _blocks(pa.Table.from_batches(whole), size, weight, mean)
                held, batch = [], batch.slice(last)
            held.append(batch)
        if held:
            yield _blocks(pa.Table.from_batches(held), size, weight, mean)

    blocks = rows.mapInArrow(packed, "term string, range long, n long, best double, docs binary, counts binary, lengths binary, positions binary")
    return Index(cut(blocks.repartitionByRange("term", "range").sortWithinPartitions("term", "range")), docs.select("doc_no", "id", "length"), n, mean, weights)


def bounds(ix: Index, wanted: list[str]) -> DataFrame:
    """range, blocks and most (no document's score is above) for the ranges that hold
    any of the terms, from what blocks say of themselves; and idf by term, joined on."""
    heads = ix.blocks.where(F.col("term").isin(wanted)).select("term", "range", "n", "best")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", F.log(1 + (ix.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    met = heads.join(F.broadcast(idf), "term")  # a row for each wanted term
    return met.groupBy("range").agg(F.count("*").alias("blocks"), F.sum(F.col("idf") * F.col("best")).alias("most"), F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"))


def _scores(weights: list[float], mean: float, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    weight = np.array(weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for where, blocks in frame.itertuples(index=False, name=None):
                total = np.zeros(RANGE)
                found = np.zeros(RANGE, bool)
                for b in sorted(blocks, key=lambda b: b["term"]):  # one order of sums everywhere
                    doc, length = np.cumsum(unpack(b["docs"])), unpack(b["lengths"])
                    f = unpack(b["counts"]).reshape(len(doc), -1) @ weight
                    total[doc] += b["idf"] * _gain(f, length, mean)
                    found[doc] = True
                at = np.flatnonzero(found)
                at = at[np.lexsort((at, -np.round(total[at], 9)))][:k]
                out += [(int(where * RANGE + a), float(total[a])) for a in at]
            yield pd.DataFrame(out, columns=["doc_no", "score"])

    return run


def score(ix: Index, ranges: DataFrame, wanted: list[str], k: int) -> DataFrame:
    """doc_no and score of the k best documents of each of the ranges (range, idf)."""
    read = ix.blocks.where(F.col("term").isin(wanted)).select("term", "range", "docs", "counts", "lengths").join(ranges.select("range", "idf"), "range")
    block = F.struct("term", F.element_at("idf", F.col("term")).alias("idf"), "docs", "counts", "lengths")
    return read.groupBy("range").agg(F.collect_list(block).alias("blocks")).mapInPandas(_scores(ix.weights, ix.mean, k), "doc_no long, score double")


def top(ix: Index, wanted: list[str], k: int = 10, first: int = 8) -> tuple[DataFrame, DataFrame]:
    """The k documents (id, score, rank) with the best scores, ties to smaller ids, and
    the ranges with ``read``: whether a search had to look into their blocks.  The
    ``first`` most promising ranges give a kth score; of the others only those that
    promise as much are read, all at once."""
    wanted = sorted(set(wanted))
    ranges = cut(bounds(ix, wanted))
    # the first ranges by promise: a top-n, never a sort of all
    lead = ranges.orderBy(F.desc("most"), "range").limit(first)
    some = cut(score(ix, lead, wanted, k))
    kth = some.orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = kth["least"] if kth["n"] == k else -1.0
    marked = cut(ranges.join(F.broadcast(lead.select("range", F.lit(True).alias("lead"))), "range", "left").withColumn("read", F.coalesce("lead", F.lit(False)) | (F.col("most") >= least - 1e-9)))
    both = some.unionByName(score(ix, marked.where("read AND lead IS NULL"), wanted, k))
    best = both.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_no").limit(k)
    ranked = best.join(ix.docs.select("doc_no", "id"), "doc_no").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_no")))  # k rows
    return ranked.select("id", "score", "rank"), marked.select("range", "blocks", "most", "read")


def phrase(ix: Index, wanted: list[str]) -> DataFrame:
    """id of the documents that hold the terms next to one another in one field."""
    fields, words = len(ix.weights), list(wanted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for where, blocks in frame.itertuples(index=False, name=None):
                held = {}
                for b in blocks:
                    doc, count = np.cumsum(unpack(b["docs"])), unpack(b["counts"])
                    cell = np.repeat((doc[:, None] * fields + np.arange(fields)).ravel(), count)
                    step = unpack(b["positions"])
                    # positions start anew in every field of every document
                    sums = np.cumsum(step)
                    new = np.flatnonzero(np.diff(cell, prepend=-1))
                    sums -= np.repeat(sums[new] - step[new], np.diff(np.append(new, len(cell))))
                    held[b["term"]] = set(zip(cell.tolist(), sums.tolist(), strict=True))
                if all(w in held for w in words):
                    hits = {c for c, p in held[words[0]] if all((c, p + i) in held[w] for i, w in enumerate(words))}
                    out += [(int(where * RANGE + d),) for d in sorted({c // fields for c in hits})]
            yield pd.DataFrame(out, columns=["doc_no"])

    read = ix.blocks.where(F.col("term").isin(words)).groupBy("range").agg(F.collect_list(F.struct("term", "docs", "counts", "positions")).alias("blocks"))
    found = read.where(F.size("blocks") == len(set(words))).mapInPandas(run, "doc_no long")
    return found.join(ix.docs, "doc_no").select("id")
