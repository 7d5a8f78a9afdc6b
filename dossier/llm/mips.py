"""Exact top-k inner products: ball-tree branch and bound per shard.

Each shard of at most about ``SHARD`` distinct vectors holds a ball tree.  A node
with centre c and radius r can't hold a score above q.c + |q| r; nodes are
visited from the largest bound down, until the bound falls below the current kth
score.  That score is shared: a query is first searched in one home shard, and
the kth score found there is where its search of every other shard begins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, vectors

SHARD, LEAF = 16384, 64


class BallTree:
    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, last, left, right
        self.centres, self.radii = [], []
        self._split(0, len(x))
        self.centre = np.array(self.centres)
        self.radius = np.array(self.radii)
        self.sorted = x[self.order]

    def _split(self, a: int, b: int) -> int:
        own = self.x[self.order[a:b]]
        c = own.mean(0)
        far = ((own - c) ** 2).sum(1)
        me = len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        self.centres.append(c)
        self.radii.append(float(np.sqrt(far.max())))
        if b - a > LEAF:
            p = own[far.argmax()]
            away = ((own - p) ** 2).sum(1)
            axis = own[away.argmax()] - p
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own @ axis, half)]
            left = self._split(a, a + half)
            right = self._split(a + half, b)
            self.nodes[me] = (a, b, left, right)
        return me

    def search(self, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k largest products, none below floor; of equal
        kth scores, all."""
        bound = self.centre @ q + np.sqrt(q @ q) * self.radius
        bound += 1e-6 * (1 + np.abs(bound))  # rounding never hides a node
        heap = [(-bound[0], 0)]
        rows, scores, kth = np.zeros(0, np.int64), np.zeros(0), floor
        while heap:
            b, i = heapq.heappop(heap)
            if -b < kth:
                break
            first, last, left, right = self.nodes[i]
            if left >= 0:
                for j in (left, right):
                    if bound[j] >= kth:
                        heapq.heappush(heap, (-bound[j], j))
                continue
            s = self.sorted[first:last] @ q
            ok = s >= kth
            if ok.any():
                rows = np.concatenate([rows, self.order[first:last][ok]])
                scores = np.concatenate([scores, s[ok]])
                if len(scores) > k:
                    kth = max(kth, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    near = scores >= kth
                    rows, scores = rows[near], scores[near]
                elif len(scores) == k:
                    kth = max(kth, float(scores.min()))
        return rows, scores


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (shard, kind): of each shard its items, then queries."""
        shard, items, tree = None, [], None
        for batch in batches:
            shards, kinds = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            if not len(shards):
                continue
            edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for a, b in zip(edges[:-1], edges[1:]):
                piece = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, items, tree = shards[a], [], None
                if kinds[a] == 0:
                    items.append(piece)
                elif items:
                    if tree is None:
                        # whole numbers below 2 ** 53 all the way: products are exact
                        tree = BallTree(np.concatenate([vectors.matrix(x.column("v")) for x in items]))
                        rep = np.concatenate([x.column("id").to_numpy() for x in items])
                        ids = pa.concat_arrays([x.column("ids") for x in items])
                    q = vectors.matrix(piece.column("v"))
                    out_q, out_i, out_s = [], [], []
                    for i, (query, floor) in enumerate(zip(piece.column("id").to_pylist(), piece.column("floor").to_pylist())):
                        rows, scores = tree.search(q[i], k, -np.inf if floor is None else floor)
                        top = np.lexsort((rep[rows], -scores))[:k]
                        out_q += [query] * len(top)
                        out_i += rows[top].tolist()
                        out_s += scores[top].tolist()
                    at = np.array(out_i, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(rep[at]), ids.take(pa.array(at)), pa.array(np.array(out_s).astype(np.int64))], names=["query_id", "rep", "ids", "score"])

    return run


def top_products(rows: DataFrame, k: int = 5, scale: int = 256, every: int = vectors.QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest integer inner products of each query, exactly.

    Every component x becomes floor(scale * x), as double.  Queries are the rows
    whose id is divisible by ``every``; candidates are all rows but the query's
    own.  Rows: query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows with a null id; zero vectors do.  Equal vectors are stored
    once, with the ids that can matter.  Rows repeated under one id count once.
    Scores must stay below 2 ** 53.  Vectors of another length than most take no
    part.
    """
    spark = rows.sparkSession
    scratch = shared.Scratch(spark, "mips")
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & vectors.sound("x"))
    # + 0.0 makes -0.0 and 0.0 one vector
    v = v.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("double") + F.lit(0.0)).alias("v"))
    v = vectors.one_length(scratch.cut(v.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors"), "v")
    items = scratch.cut(vectors.collapse(v, "v", k + 1), "items")
    shards = max(1, -(-items.count() // SHARD))
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(shards))
    stored = items.select(home("rep").alias("shard"), F.lit(0).alias("kind"), F.col("rep").alias("id"), "v", "ids", F.lit(None).cast("double").alias("floor"))
    queries = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")

    def search(asked: DataFrame) -> DataFrame:
        asked = asked.select("shard", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v", F.lit(None).cast("array<long>").alias("ids"), "floor")
        both = stored.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
        return both.mapInArrow(_search(k + 1), "query_id long, rep long, ids array<long>, score long")

    first = scratch.cut(search(queries.select("query_id", "v", home("query_id").alias("shard"), F.lit(None).cast("double").alias("floor"))), "first")
    if shards == 1:
        return vectors.rank(first, k)
    # a shard can hold fewer than k + 1 distinct vectors; then there is no floor
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k + 1, F.min("score").cast("double")).alias("floor"))
    others = queries.join(floors, "query_id", "left").select("query_id", "v", "floor", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).where(F.col("shard") != home("query_id"))
    return vectors.rank(first.unionByName(search(others)), k)
