"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors of unit length are hashed, in each of ``TABLES`` tables, to the floors of
``FUNCTIONS`` Gaussian projections, shifted at random and divided by ``WIDTH``.
A query visits its own bucket and the buckets of perturbations of it by +-1, in the
order of their estimated success: the sum of squared distances to the boundaries
crossed, generated best first.  The candidates of all tables are merged and ranked by
their exact cosine.

Probes adapt to each query.  The first ``PROBES`` buckets give a kth score.  At that
distance a neighbour differs from the query by a Gaussian of known width in every
projection, so each perturbation has a known chance to hold it.  The query goes on
until the chances of its buckets reach ``SUCCESS`` over all tables; if ``MOST`` buckets
a table don't, it is compared with all vectors.

Directions in a space where everything is nearly orthogonal to a query (here the
fifth neighbour has a cosine near 0.4 against a deviation of 1/8) share few
buckets and take many probes.  Vectors with closer neighbours do with few.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, vectors

TABLES, FUNCTIONS, WIDTH, PROBES, SEED = 4, 10, 2.5, 200, 7
SUCCESS, MOST = 0.95, 4096
PIECE = 4096
GROUP_ROWS = 8192


def _family(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections (tables, dim, functions) and shifts; orthogonal rows where the
    dimension allows, as they repeat less, with Gaussian lengths."""
    rng = np.random.default_rng((SEED, dim))
    a = rng.standard_normal((TABLES, dim, FUNCTIONS))
    if dim >= FUNCTIONS:
        a = np.stack([np.linalg.qr(x)[0] * np.sqrt(dim) for x in a])
    return a, rng.uniform(0, WIDTH, (TABLES, FUNCTIONS))


def _keys(table: int, cells: np.ndarray) -> np.ndarray:
    """Bucket coordinates (n, FUNCTIONS) to 64-bit keys that include the table."""
    key = np.full(len(cells), table, np.int64)
    for j in range(cells.shape[1]):
        key = key * 64 + (np.clip(cells[:, j], -31, 31) + 32) if cells.shape[1] <= 9 else key * 32 + (np.clip(cells[:, j], -15, 15) + 16)
    return key


_template: dict[tuple[int, int], list[list[int]]] = {}


def probe_sets(functions: int, probes: int) -> list[list[int]]:
    """Perturbation sets over the ranks 0 .. 2 * functions - 1 of the sorted
    boundary distances, in the order of their expected sums.  Ranks j and
    2 * functions - 1 - j belong to one function and never go together."""
    if (functions, probes) not in _template:
        m = 2 * functions
        j = np.arange(1, m + 1)
        half = j <= functions
        # expected squares of order statistics of uniform distances to a boundary
        z = np.where(half, j * (j + 1) / (4 * (functions + 1) * (functions + 2)), 1 - (m + 1 - j) / (functions + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (functions + 1) * (functions + 2)))
        fits = lambda s: not any(m - 1 - x in s for x in s)
        out: list[list[int]] = [[]]
        heap = [(float(z[0]), [0])]
        while heap and len(out) < probes:
            score, s = heapq.heappop(heap)
            if fits(s):
                out.append(s)
            last = s[-1]
            if last + 1 < m:
                heapq.heappush(heap, (score - z[last] + z[last + 1], [*s[:-1], last + 1]))
                heapq.heappush(heap, (score + z[last + 1], [*s, last + 1]))
        _template[functions, probes] = out
    return _template[functions, probes]


def _project(x: np.ndarray, table: int) -> np.ndarray:
    a, b = _family(x.shape[1])
    return ((x / np.sqrt((x * x).sum(1))[:, None]) @ a[table] + b[table]) / WIDTH


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = vectors.matrix(batch.column("v"))
        for t in range(TABLES):
            key = _keys(t, np.floor(_project(x, t)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("ids"), batch.column("v"), pa.array(key)], names=["rep", "ids", "v", "bucket"])


def _moves(f: np.ndarray, sets: list[list[int]]) -> np.ndarray:
    """Perturbations (sets, FUNCTIONS) of one query: sets are of ranks, and crossing a
    boundary down costs f, up 1 - f."""
    order = np.argsort(np.concatenate([f, 1 - f]), kind="stable")
    which = order[np.array([x for s in sets for x in s], np.int64)]
    move = np.zeros((len(sets), FUNCTIONS), np.int64)
    move[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), which % FUNCTIONS] += np.where(which < FUNCTIONS, -1, 1)
    return move


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first PROBES buckets of each table."""
    sets = probe_sets(FUNCTIONS, PROBES)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = vectors.matrix(batch.column("v"))
        ids = batch.column("query_id").to_pylist()
        for t in range(TABLES):
            p = _project(x, t)
            cell = np.floor(p).astype(np.int64)
            for i, q in enumerate(ids):
                key = np.unique(_keys(t, cell[i] + _moves(p[i] - cell[i], sets)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), q)), pa.array(key)], names=["query_id", "bucket"])


def _normal(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x.ravel()]).reshape(x.shape)


def chances(f: np.ndarray, moves: np.ndarray, far: float) -> np.ndarray:
    """The chance that a neighbour at distance ``far`` lies in each perturbed bucket of
    a query at ``f`` in its own: its projections differ by Gaussians of width
    far / WIDTH."""
    edges = _normal((np.arange(-1, 3)[:, None] - f) / max(far / WIDTH, 1e-9))
    each = np.maximum(np.diff(edges, axis=0), 1e-300)
    return np.exp(np.log(each[moves + 1, np.arange(FUNCTIONS)]).sum(1))


def _more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets beyond the first PROBES, as many as the query's kth score asks for; a
    null bucket if MOST aren't enough."""
    sets = probe_sets(FUNCTIONS, MOST)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = vectors.matrix(batch.column("v"))
        p = [_project(x, t) for t in range(TABLES)]
        for i, (q, least) in enumerate(zip(batch.column("query_id").to_pylist(), batch.column("least").to_pylist(), strict=True)):
            far = math.sqrt(max(0.0, 2 - 2 * least))
            cells = [np.floor(p[t][i]).astype(np.int64) for t in range(TABLES)]
            moves = [_moves(p[t][i] - cells[t], sets) for t in range(TABLES)]
            missed = np.prod([1 - np.minimum(1, np.cumsum(chances(p[t][i] - cells[t], moves[t], far))) for t in range(TABLES)], axis=0)
            n = int(np.searchsorted(-missed, -(1 - SUCCESS))) + 1
            if n > len(sets):
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([None], pa.int64())], names=["query_id", "bucket"])
                continue
            for t in range(TABLES):
                key = np.unique(_keys(t, cells[t] + moves[t][PROBES:n]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), q)), pa.array(key)], names=["query_id", "bucket"])


def _rerank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (part, kind): of each part first its items (kind 0),
        then its queries with the buckets they visit there (kind 1)."""
        part, items, tree = None, [], None
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            kinds = np.asarray(batch.column("kind"))
            edges = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1]), True]) if len(parts) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                piece = batch.slice(a, b - a)
                if parts[a] != part:
                    part, items, tree = parts[a], [], None
                if kinds[a] == 0:
                    items.append(piece)
                elif items:
                    tree = tree or _buckets(items)
                    yield from _visit(tree, piece, k)

    return run


def _buckets(items: list[pa.RecordBatch]):
    x = np.concatenate([vectors.matrix(b.column("v")) for b in items])
    bucket = np.concatenate([b.column("bucket").to_numpy() for b in items])
    rep = np.concatenate([b.column("id").to_numpy() for b in items])
    ids = pa.concat_arrays([b.column("ids") for b in items])
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    # a vector lies in a bucket of every table; it is held and scored once
    rep, one, which = np.unique(rep, return_index=True, return_inverse=True)
    x = x[one]
    return x, np.sqrt((x * x).sum(1)), rep, ids.take(pa.array(one)), which[order], names, np.append(first, len(order))


def _visit(tree, queries: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    x, norm, rep, ids, order, names, first = tree
    out_q, out_i, out_s = [], [], []
    q = vectors.matrix(queries.column("v"))
    for i, (query, visits) in enumerate(zip(queries.column("id").to_pylist(), queries.column("visits"))):
        # no buckets named: all of them
        at = np.searchsorted(names, np.unique(visits.values.to_numpy())) if len(visits) else range(len(names))
        rows = np.unique(np.concatenate([order[first[j] : first[j + 1]] for j in at]))
        approx = (x[rows] @ q[i]) / norm[rows]
        best = rows
        if len(rows) > k:
            best = rows[approx >= np.partition(approx, len(rows) - k)[len(rows) - k] - 1e-9]
        # always summed in one order, so that equal pairs score equally everywhere
        score = (x[best] * q[i]).sum(1) / (norm[best] * np.sqrt((q[i] * q[i]).sum()))
        top = np.lexsort((rep[best], -score))[:k]
        out_q += [query] * len(top)
        out_i += best[top].tolist()
        out_s += score[top].tolist()
    at = np.array(out_i, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(rep[at]), ids.take(pa.array(at)), pa.array(out_s, pa.float64())], names=["query_id", "rep", "ids", "score"])


def nearest(rows: DataFrame, k: int = 5, every: int = vectors.QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query, by cosine in double precision.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own.  Rows: query_id, rank (from 1), vec_id, score;
    ties go to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do rows with a null id.  Equal vectors are indexed once, with
    the ids that can matter.  Vectors of another length than most take no
    part.  Of several vectors under one id the smallest, component by component,
    counts.  A query whose first buckets hold too few candidates, or whose chances stay
    below SUCCESS, is searched in all buckets.  Other columns are not read.
    """
    spark = rows.sparkSession
    scratch = shared.Scratch(spark, "ann")
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & vectors.sound("v") & F.exists("v", lambda x: x != 0))
    v = vectors.one_length(scratch.cut(v.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors"), "v")
    items = scratch.cut(vectors.collapse(v, "v", k + 1), "items")
    queries = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")

    index = scratch.cut(items.mapInArrow(_hash, "rep long, ids array<long>, v array<double>, bucket long"), "index")
    # buckets are dealt to parts in pieces of bounded size
    directory = scratch.cut(index.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / PIECE)), "directory")
    total = directory.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // GROUP_ROWS))
    part = lambda piece: F.pmod(F.xxhash64("bucket", piece), F.lit(parts)).alias("part")
    spread = index.join(directory, "bucket").select(part(F.pmod(F.xxhash64("rep"), F.col("pieces"))), F.lit(0).alias("kind"), F.col("rep").alias("id"), "v", "ids", "bucket", F.lit(None).cast("array<long>").alias("visits"))

    def search(visits: DataFrame) -> DataFrame:
        asked = visits.join(queries, "query_id").select("part", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("long").alias("bucket"), "visits")
        both = spread.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind")
        return both.mapInArrow(_rerank(k + 1), "query_id long, rep long, ids array<long>, score double")

    def visits(probes: DataFrame) -> DataFrame:
        dealt = probes.join(directory, "bucket").select("query_id", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        return dealt.select("query_id", "bucket", part("piece")).groupBy("query_id", "part").agg(F.collect_set("bucket").alias("visits"))

    first = scratch.cut(search(visits(queries.mapInArrow(_probe, "query_id long, bucket long"))), "first")
    enough = vectors.rank(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    asked = queries.join(enough, "query_id").select("query_id", "v", "least")
    more = scratch.cut(asked.mapInArrow(_more, "query_id long, bucket long"), "more")
    second = scratch.cut(search(visits(more)), "second")
    found = first.unionByName(second)
    open_ = queries.join(enough, "query_id", "left_anti").select("query_id").unionByName(more.where("bucket IS NULL").select("query_id"))
    open_ = scratch.cut(open_, "open")
    if open_.isEmpty():
        return vectors.rank(found, k)
    everywhere = open_.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.array().cast("array<long>").alias("visits"))
    return vectors.rank(found.unionByName(scratch.cut(search(everywhere), "everywhere")), k)
