"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. Every text becomes its set of word shingles and a signature of ``COORDINATES``
   minima.  Texts with equal sets collapse to one representative.
2. Each representative is posted under every (coordinate, value).  Values that
   one document alone has are dropped, and so is every document that keeps
   fewer than ``MATCHES`` shared values: it can reach no partner.
3. Prefix: two documents that agree on at least T values share one among the
   c - T + 1 rarest shared values of each (c: how many shared values it has, in
   one global order).  Only those postings are merged; collisions under the
   skipped values are looked up in the signatures of the candidates alone.
4. Stars: in every posting the document with the most company is its lead, and
   all others are counted and confirmed against it.  A group of near copies is
   settled so with as many pairs as it has members; a posting whose members are
   all linked to one lead is done.
5. What is left: the members of the other postings gather in blocks of bounded
   shingle mass, by the longest posting within ``HOPS`` steps, and two blocks that
   share such a posting are one unit of work.
   Within it collisions are counted by merging prefix postings, pairs with at
   least T are tried best first, and each is confirmed on the full sets unless
   the two are already known to be connected.  Only confirmed forest edges leave
   a task.
6. Components of all links, spread back over the equal sets.

With 64 coordinates and T = 28, a pair of similarity 0.75 is missed with a
probability below one in ten million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, words

COORDINATES, MATCHES, SHINGLE = 64, 28, 5
NEAR_PERCENT = 75
BLOCK_SHINGLES = 1 << 19
STAR_PART = 512
FLOOR, LIKELY = 14, 44
HOPS = 3
_rng = np.random.default_rng(75)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_CHUNK = 1 << 16


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES minima for each set that isn't empty, as keys that
    already tell coordinates apart."""
    full = [s for s in sets if len(s)]
    out = np.empty((len(full), COORDINATES), np.uint64)
    first = 0
    while first < len(full):
        last, size = first, 0
        while last < len(full) and (last == first or size + len(full[last]) <= _CHUNK):
            size += len(full[last])
            last += 1
        flat = np.concatenate(full[first:last])
        at = np.zeros(last - first, np.int64)
        np.cumsum([len(s) for s in full[first : last - 1]], out=at[1:])
        for k in range(COORDINATES):
            v = flat * _A[k]
            v += _B[k]
            out[first:last, k] = np.minimum.reduceat(v ^ (v >> np.uint64(32)), at)
        first = last
    return words.mix(out + _B)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.trim()
    for batch in batches:
        ids, texts = batch.column("doc_id"), shared.texts_of(batch)
        for a, b in words.batches(texts):
            sets = words.shingle_sets([t.translate(words.LOWER) if t else t for t in texts[a:b]], SHINGLE)
            n = np.array([len(s) for s in sets])
            sig = signatures(sets)
            h = np.array([_digest(s) for s in sets]).reshape(-1, 2)
            offsets = np.zeros(b - a + 1, np.int32)
            np.cumsum((n > 0) * COORDINATES, out=offsets[1:])
            values = pa.array(sig.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(n), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["doc_id", "n_shingles", "h1", "h2", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, h1, h2, text) to the sorted set as bytes; only the text whose set has
    those hashes counts, as several may stand under one id."""
    shared.trim()
    for batch in batches:
        texts = shared.texts_of(batch)
        for a, b in words.batches(texts):
            sets = words.shingle_sets([t.translate(words.LOWER) if t else t for t in texts[a:b]], SHINGLE)
            want = [batch.column(c).slice(a, b - a).to_pylist() for c in ("node", "h1", "h2")]
            real = [(node, s.tobytes()) for node, x, y, s in zip(*want, sets) if (x, y) == _digest(s)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in real], pa.int64()), pa.array([r[1] for r in real], pa.binary())], names=["node", "set"])


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed integers."""
    x = np.array([s.sum(dtype=np.uint64), words.mix(s * _A[0] + _B[1]).sum(dtype=np.uint64)], np.uint64)
    return tuple(x.view(np.int64).tolist())


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= NEAR_PERCENT * union, of sorted distinct arrays."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < NEAR_PERCENT * large:
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= NEAR_PERCENT * (len(x) + len(y) - both)


def collisions(sig: np.ndarray, split: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row i of keys, the rows j > i with at least MATCHES keys in common
    and how many, by prefix and skip merging; with ``split``, only for i < split <= j.  Of c shared keys the c - MATCHES +
    FLOOR rarest have postings that are merged; two rows with MATCHES keys in common
    share FLOOR of them at least, and only for those rows the longer postings are
    looked up, in the signatures."""
    m, k = sig.shape
    keys, which, df = np.unique(sig, return_inverse=True, return_counts=True)
    which = which.reshape(m, k)
    freq = np.where(df[which] > 1, df[which], m + 1)
    order = np.lexsort((which, freq), axis=1)
    mine = np.take_along_axis(which, order, axis=1)
    have = (freq <= m).sum(axis=1)
    merged = (np.arange(k) < (have - MATCHES + FLOOR)[:, None]) & (have >= MATCHES)[:, None] & (np.arange(k) < have[:, None])
    probed = merged.copy()
    probed[:split] = False  # only the far side is posted
    row, value = np.nonzero(probed)[0], mine[probed]
    posted = np.argsort(value, kind="stable")
    postings, heads = row[posted], np.searchsorted(value[posted], np.arange(len(keys) + 1))
    for i in range(split or m - 1):
        own = mine[i, merged[i]]
        if not len(own):
            continue
        counts = np.bincount(np.concatenate([postings[heads[v] : heads[v + 1]] for v in own.tolist()]), minlength=m)
        js = i + 1 + np.flatnonzero(counts[i + 1 :] >= FLOOR)
        if len(js):
            hits = np.count_nonzero(sig[js] == sig[i], axis=1)
            ok = hits >= MATCHES
            if ok.any():
                yield i, js[ok], hits[ok]


def near_any(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``near`` of one set and each of several, in one go."""
    size = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    at = np.searchsorted(x, flat)
    at[at == len(x)] = 0
    both = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(size) - size)
    return 100 * both >= NEAR_PERCENT * (len(x) + size - both)


def _forest(nodes: list[int], known: list[int], split: int, sig: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Confirmed links between members that connect all that links connect.
    known: the component each is already in; split: how many belong to the first
    of two sides, where only links between sides are wanted, else 0."""
    at: dict[int, int] = {}
    root = [at.setdefault(c, i) for i, c in enumerate(known)]
    size = np.array([len(s) for s in sets])

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((nodes[i], nodes[j]))

    likely, rest = [], []
    for i, js, hits in collisions(sig, split):
        ok = 100 * np.minimum(size[js], size[i]) >= NEAR_PERCENT * np.maximum(size[js], size[i])
        sure = ok & (hits >= LIKELY)
        likely.append((hits[sure].astype(np.int32), np.full(int(sure.sum()), i, np.int32), js[sure].astype(np.int32)))
        ok &= ~sure
        if ok.any():
            rest.append((i, js[ok]))
    if likely:  # the best first: they settle most of the others
        hits, left, right = (np.concatenate(x) for x in zip(*likely))
        order = np.lexsort((right, left, -hits))
        for first in range(0, len(order), STAR_PART):
            part = order[first : first + STAR_PART]
            for i, j in zip(left[part].tolist(), right[part].tolist()):
                if find(i) != find(j) and near(sets[i], sets[j]):
                    link(i, j)
    for i, js in rest:
        own = find(i)
        js = [j for j in js.tolist() if find(j) != own]
        for first in range(0, len(js), STAR_PART):
            part = js[first : first + STAR_PART]
            for j in np.flatnonzero(near_any(sets[i], [sets[j] for j in part])).tolist():
                link(i, part[j])
    return out


LINK = "u long, v long"


def _links(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        u, v = zip(*pairs)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _confirm_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit: one after another."""
    shared.trim()
    unit, nodes, known, sides, sigs, sets = None, [], [], [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            yield from _links(_forest(nodes, known, sides.count(0) if 1 in sides else 0, np.stack(sigs), sets))

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("lo", "hi", "node", "component", "block", "set")]
        rows = batch.column("sig").flatten().to_numpy().view(np.uint64).reshape(-1, COORDINATES)
        for lo, hi, node, c, block, data, row in zip(*cols, rows):
            if (lo, hi) != unit:
                yield from done()
                unit, nodes, known, sides, sigs, sets = (lo, hi), [], [], [], [], []
            nodes.append(node)
            known.append(c)
            sides.append(int(block != lo))
            sigs.append(row)
            sets.append(np.frombuffer(data, np.uint64))
    yield from done()


def _confirm_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lead, part), the lead's own set (node null) first."""
    shared.trim()
    lead, own = None, None
    for batch in batches:
        found = []
        for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("lead", "node", "set"))):
            s = np.frombuffer(data, np.uint64)
            if b is None:
                lead, own = a, s
            elif a == lead and near(own, s):
                found.append((a, b))
        yield from _links(found)


def _star_links(pairs: DataFrame, sets: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """The pairs (lead, node) that the full sets confirm.  A lead's partners are
    dealt over parts of about STAR_PART, each with a copy of its set."""
    many = scratch.cut(pairs.groupBy("lead").agg(F.ceil(F.count("*") / STAR_PART).alias("parts")), "star-parts", "zstd")
    dealt = pairs.join(many.select(F.col("lead").alias("l"), "parts"), F.col("lead") == F.col("l")).select("lead", "node", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    heads = many.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    heads = heads.join(sets.select(F.col("node").alias("n"), "set"), F.col("lead") == F.col("n")).select("lead", F.lit(None).cast("long").alias("node"), "part", "set")
    rest = dealt.join(sets.select(F.col("node").alias("n"), "set"), F.col("node") == F.col("n")).select("lead", "node", "part", "set")
    order = ["lead", "part", F.col("node").asc_nulls_first()]
    return heads.unionAll(rest).repartition("lead", "part").sortWithinPartitions(*order).mapInArrow(_confirm_stars, LINK)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate documents.

    Returns one row for each row of ``docs``: doc_id, n_shingles, component_id
    (smallest id reachable over links, itself included) and kept (doc_id =
    component_id).  Texts are compared by their sets of five-word shingles, A-Z
    lower-cased; two are linked from a similarity of 0.75 on.

    Null or wordless texts have an empty set, link with nothing and are their own
    component.  Rows under one id are one document: what one of their texts
    reaches, all reach that have words.  A row with a null id names no document:
    it links with nothing, its component_id and kept are null.  An empty table
    gives an empty result.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    with shared.small_batches(spark):
        return _near_duplicates(spark, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def _near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    scratch = shared.Scratch(spark, "minhash")
    signed = scratch.cut(docs.mapInArrow(_sign, "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one text, and later one node
    reps = scratch.cut(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "reps")
    reps = reps.withColumn("node", F.xxhash64("h1", "h2"))

    posted = reps.select("node", F.explode("sig").alias("key"))
    counts = scratch.cut(posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "counts", "zstd")
    common = posted.join(counts, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys")).where(F.size("keys") >= MATCHES)
    company = F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + x.df)
    prefix = common.select("node", company.alias("company"), F.explode(F.slice("keys", F.lit(1), F.size("keys") - MATCHES + 1)).alias("x"))
    prefix = scratch.cut(prefix.select("node", "company", F.col("x.key").alias("key")), "prefix")
    members = scratch.cut(reps.join(prefix.select("node").distinct(), "node").select("node", "doc", "h1", "h2", "n", "sig"), "members")
    sets = members.join(docs, F.col("doc_id") == F.col("doc")).select("node", "h1", "h2", "text").mapInArrow(_sets, "node long, set binary")
    ids = scratch.cut(full.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("rows")), "ids", "zstd")
    if not ids.where("rows > 1").isEmpty():  # equal rows under one id
        sets = sets.dropDuplicates(["node"])
    sets = scratch.cut(sets, "sets")

    leads = prefix.groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    leads = scratch.cut(leads.select("key", "lead"), "leads", "zstd")
    pairs = prefix.join(leads, "key").where("node <> lead").select("lead", "node").distinct()
    sig = members.select(F.col("node").alias("n1"), F.col("n").alias("size1"), F.col("sig").alias("sig1"))
    other = sig.toDF("n2", "size2", "sig2")
    pairs = pairs.join(sig, F.col("lead") == F.col("n1")).join(other, F.col("node") == F.col("n2"))
    pairs = pairs.where(100 * F.least("size1", "size2") >= NEAR_PERCENT * F.greatest("size1", "size2"))
    pairs = scratch.cut(pairs.where(F.size(F.array_intersect("sig1", "sig2")) >= MATCHES).select("lead", "node"), "matched")
    stars = scratch.cut(_star_links(pairs, sets, scratch), "stars")

    # postings whose members aren't all linked to one lead; their own leads have met everyone
    settled = stars.groupBy(F.col("v").alias("s")).agg(F.min("u").alias("component"))
    lists = prefix.join(leads, "key").where("node <> lead").join(settled, F.col("node") == F.col("s"), "left")
    lists = scratch.cut(lists.select("key", "node", F.coalesce("component", "node").alias("component")), "lists", "zstd")
    mixed = lists.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    mixed = scratch.cut(mixed.select("key", "size"), "mixed", "zstd")
    left = scratch.cut(lists.join(mixed, "key"), "left", "zstd")
    # blocks: members gather at the longest posting within a few steps, in parts of bounded mass
    best = left.select("key", "node", F.struct("size", "key").alias("post"))
    for step in range(HOPS):
        at = best.groupBy("node").agg(F.max("post").alias("post")).select(F.col("node").alias("n"), "post")
        if step + 1 < HOPS:
            top = left.select("key", "node").join(at, F.col("node") == F.col("n")).groupBy("key").agg(F.max("post").alias("post")).withColumnRenamed("key", "k")
            best = left.select("key", "node").join(scratch.cut(top, f"top-{step}", "zstd"), F.col("key") == F.col("k")).select("key", "node", "post")
    home = left.groupBy("node").agg(F.first("component").alias("component")).join(at, F.col("node") == F.col("n")).select("node", "component", F.col("post.key").alias("home"))
    home = scratch.cut(home.join(members.select(F.col("node").alias("m"), "n", "sig"), F.col("node") == F.col("m")).drop("m"), "home")
    parts = scratch.cut(home.groupBy(F.col("home").alias("h")).agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts")), "parts", "zstd")
    blocks = home.join(parts, F.col("home") == F.col("h")).select("node", "component", "sig", F.xxhash64("home", F.pmod(F.xxhash64("node"), "parts")).alias("block"))
    blocks = scratch.cut(blocks, "blocks")
    # a block's members take part in a unit if they have a posting that reaches the other block
    placed = left.select("key", "node").join(blocks.select(F.col("node").alias("b"), "block"), F.col("node") == F.col("b")).select("key", "node", "block")
    reach = placed.groupBy("key").agg(F.collect_set("block").alias("blocks"))
    units = placed.join(reach, "key").select("node", "block", F.explode("blocks").alias("other")).distinct()
    units = scratch.cut(units.select(F.col("node").alias("member"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")), "units")
    work = units.join(blocks, F.col("node") == F.col("member")).join(sets.withColumnRenamed("node", "s"), F.col("node") == F.col("s"))
    work = work.select("lo", "hi", "node", "component", "block", "sig", "set").repartition("lo", "hi").sortWithinPartitions("lo", "hi", "block", "node")
    links = stars.unionAll(work.mapInArrow(_confirm_units, LINK))

    # texts of one document are one node
    ids = ids.select("doc_id", F.xxhash64("h1", "h2").alias("node"))
    several = ids.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("last")).where("u < last").select("doc_id", "u")
    ties = ids.join(several, "doc_id").select("u", F.col("node").alias("v"))
    found = scratch.cut(shared.components(links.unionAll(ties), scratch, "link"), "found")
    scratch.drop("prefix", "members", "sets", "lists", "left", "counts", "ids")

    named = reps.select("h1", "h2", "node", "doc").join(found, "node", "left").select("h1", "h2", "doc", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    named = scratch.cut(named.join(least, "component").select("h1", "h2", "least"), "named")
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies of a document with
    a smaller id.  Rows with a null id stay, as do all rows of a kept id and documents
    without words; an empty table stays empty; other columns pass through."""
    free = "_" * (1 + max(map(len, docs.columns)))  # a name that no column has
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(free)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(free), "left_anti")
