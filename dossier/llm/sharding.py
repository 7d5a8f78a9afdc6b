"""Sharding by balanced label propagation, with DataFrame functions only.

Documents that share the value of ``by`` (their text, unless told otherwise) are
linked.  Each linked document starts in a shard by its hash.  In every round the
members of a group vote with their bytes, and those outside the group's leading
shards wish to move to one of them: a join of the documents with the votes.  A
group larger than a shard leads in as many shards as it fills.  Moves between two
shards obey a quota: what wants to come the other way, plus a part of the room that
is left.  Of a lane with more wishes than its quota, groups move in an order of
their size, whole ones as far as they go.  Rounds end when nobody moves.

Documents without links, and those for which a shard has no room, then fill all
shards to one level: the largest one by one to the emptiest shard, the others by
their place in a running sum.

Running sums go over cells of a hash (``running``), so no step sorts a shard or a
group as a whole.  The driver sees sums of shards and of pairs of shards, and the
documents larger than 1/256 of a shard, of which there are fewer than 256 a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SALT, Scratch

LARGE = 256
FULL = 63 / 64
ROUNDS = 12
CELL = 2048


def described(docs: DataFrame, by: Column | None = None, uid: Column | None = None) -> DataFrame:
    """uid (numbers the rows), doc_id, size, text_crc32, group (hash of what links)
    and h (hash that deals and orders) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        (F.monotonically_increasing_id() if uid is None else uid).alias("uid"),
        "doc_id",
        (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text if by is None else by).alias("group"),
    )
    return rows.withColumn("h", F.xxhash64("doc_id", "group", "uid"))


def running(rows: DataFrame, keys: list[str], amount: Column, top: Column, cell: Column, order: list[str]) -> DataFrame:
    """Adds ``ahead``: the sum of ``amount`` over the rows of the same keys that come
    before by (top, cell, order).  ``cell`` orders within ``top``.  Sums of tops and
    cells are prefix sums of their own; only rows of one cell are sorted together."""
    rows = rows.withColumn("_amount", amount.cast("long")).withColumn("_top", top).withColumn("_cell", cell)
    cells = rows.groupBy(*keys, "_top", "_cell").agg(F.sum("_amount").alias("_n"))
    tops = cells.groupBy(*keys, "_top").agg(F.sum("_n").alias("_n"))
    before = lambda parts, by: F.coalesce(F.sum("_n").over(Window.partitionBy(*parts).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select(*keys, "_top", before(keys, "_top").alias("_to_top"))
    cells = cells.withColumn("_to_cell", before([*keys, "_top"], "_cell")).join(tops, [*keys, "_top"])
    cells = cells.select(*keys, "_top", "_cell", (F.col("_to_cell") + F.col("_to_top")).alias("_start"))
    inside = Window.partitionBy(*keys, "_top", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(cells, [*keys, "_top", "_cell"])
    met = met.withColumn("ahead", F.coalesce(F.sum("_amount").over(inside), F.lit(0)) + F.col("_start"))
    return met.drop("_amount", "_top", "_cell", "_start")


def _bits(n: int) -> int:
    """Bits of a hash that leave about CELL of n rows in a cell."""
    return max(6, (max(n, 1) // CELL).bit_length())


def _by_hash(rows: DataFrame, keys: list[str], amount: Column, n: int) -> DataFrame:
    bits = _bits(n)
    return running(rows, keys, amount, F.shiftrightunsigned("h", 64 - bits // 2), F.shiftrightunsigned("h", 64 - bits), ["h", "uid"])


def _by_group(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Running sizes with large groups first and, but for a thousandth of them, one
    group behind the other; a group itself is dealt over cells by ``h``."""
    scale = F.lit(63) - F.floor(F.log2("group_size")).cast("int")
    top = scale.cast("long") * 1024 + F.shiftrightunsigned(F.xxhash64("group"), 54)
    return running(rows, keys, F.col("size"), top, F.shiftrightunsigned("h", 64 - _bits(n)), ["group", "h", "uid"])


def votes(linked: DataFrame, mean: float, full: list[int]) -> DataFrame:
    """group, lead (shards where its members should be) and open (those of its shards
    that have room), both by bytes of its members there.  A group that would fit into
    one shard and isn't in one yet doesn't wait for a full shard: its next one with
    room leads."""
    held = linked.groupBy("group", "shard").agg(F.sum("size").alias("bytes"))
    ranked = held.groupBy("group").agg(
        F.sum("bytes").alias("total"),
        F.sort_array(F.collect_list(F.struct("bytes", F.xxhash64("group", "shard").alias("tie"), "shard")), asc=False).getField("shard").alias("shards"),
    )
    count = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(mean))).cast("int")
    open_ = F.expr(f"filter(shards, s -> NOT array_contains(array({', '.join(map(str, full))}), s))") if full else F.col("shards")
    ranked = ranked.select("group", "shards", count.alias("count"), open_.alias("open"))
    moves_on = (F.col("count") == 1) & (F.size("shards") > 1) & (F.size("open") > 0)
    lead = F.when(moves_on, F.slice("open", 1, 1)).otherwise(F.slice("shards", F.lit(1), F.col("count")))
    return ranked.select("group", lead.alias("lead"), F.slice("open", F.lit(1), F.col("count")).alias("open"))


def wishes(linked: DataFrame, voted: DataFrame) -> DataFrame:
    """Adds ``wish``: the shard that a document would be in, by its group's votes.
    Votes go to all of SALT keys, so that a group's documents meet them in several
    tasks."""
    everywhere = voted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    met = linked.withColumn("salt", F.pmod("h", F.lit(SALT))).join(everywhere, ["group", "salt"])
    stays = F.array_contains("lead", F.col("shard")) | (F.size("open") == 0)
    other = F.expr("open[cast(pmod(xxhash64(h), size(open)) AS int)]")
    return met.withColumn("wish", F.when(stays, F.col("shard")).otherwise(other)).drop("salt", "lead", "open")


def quotas(wanted: dict[tuple[int, int], int], loads: list[int], capacity: float) -> dict[tuple[int, int], int]:
    """Bytes that may move from one shard to another: as many as want to come back,
    and of the room that the target has, a part by what is wanted beyond that."""
    back = {(i, j): min(w, wanted.get((j, i), 0)) for (i, j), w in wanted.items()}
    more = [sum(w - back[i, j] for (i, j), w in wanted.items() if j == s) for s in range(len(loads))]
    room = [max(0.0, capacity - x) for x in loads]
    return {(i, j): back[i, j] + min(w - back[i, j], int(room[j] * (w - back[i, j]) / more[j]) if more[j] else 0) for (i, j), w in wanted.items()}


def _loads(rows: DataFrame, shards: int) -> list[int]:
    got = dict(rows.groupBy("shard").agg(F.sum("size")).collect())
    return [got.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, scratch: Scratch, shards: int, mean: float, n: int, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of label propagation over ``linked`` (uid, size, group, group_size, h):
    adds ``shard``.  No shard ends with more than ``mean`` bytes, unless it had them
    at the start.  Shards that are full and refused somebody in the round before are
    closed to groups that aren't there."""
    rows, name = scratch.cut(linked.withColumn("shard", F.pmod(F.xxhash64(F.lit(shards), "h"), F.lit(shards)).cast("int")), "round-0"), "round-0"
    refused: set[int] = set()
    for step in range(1, rounds + 1):
        loads = _loads(rows, shards)
        full = [s for s, x in enumerate(loads) if x >= mean * FULL and s in refused]
        asked = scratch.cut(wishes(rows, votes(rows, mean, full)), f"asked-{step}")
        lanes = asked.where("wish <> shard").groupBy("shard", "wish").agg(F.sum("size")).collect()
        wanted = {(i, j): w for i, j, w in lanes}
        quota = quotas(wanted, loads, mean)
        refused = {j for (i, j), w in wanted.items() if quota[i, j] < w}
        if any(quota.values()):
            if quota != wanted:
                ask = asked.where("wish <> shard")
                limit = F.expr("CASE " + " ".join(f"WHEN shard = {i} AND wish = {j} THEN {q}" for (i, j), q in quota.items()) + " END")
                ask = _by_group(ask, ["shard", "wish"], n).withColumn("wish", F.when(F.col("ahead") + F.col("size") <= limit, F.col("wish")).otherwise(F.col("shard"))).drop("ahead")
                asked = asked.where("wish = shard").unionByName(ask)
            rows = scratch.cut(asked.drop("shard").withColumnRenamed("wish", "shard"), f"round-{step}")
            scratch.drop(name)
            name = f"round-{step}"
        scratch.drop(f"asked-{step}")
        if not any(quota.values()):
            break
    return rows


def _level(loads: list[int], amount: int) -> float:
    """The level to which ``amount`` fills shards of these loads."""
    low = sorted(loads)
    for k in range(1, len(low) + 1):
        level = (sum(low[:k]) + amount) / k
        if k == len(low) or level <= low[k]:
            return level
    return 0.0


def fill(pool: DataFrame, loads: list[int], large: float, n: int) -> DataFrame:
    """Adds ``shard`` to rows that may be anywhere, so that all loads come to one
    level.  Rows over ``large`` go one by one, largest first, to the emptiest shard;
    the others lie end to end and are cut where shards are full."""
    shards = len(loads)
    giants = pool.where(F.col("size") > large).select("size", "uid").collect()
    heap = [(x, s) for s, x in enumerate(loads)]
    heapq.heapify(heap)
    placed = []
    for size, uid in sorted(giants, key=lambda r: (-r[0], r[1])):
        load, s = heapq.heappop(heap)
        placed.append((uid, s))
        heapq.heappush(heap, (load + size, s))
    loads = [x for x, s in sorted(heap, key=lambda x: x[1])]
    rest = pool.where(F.col("size") <= large)
    total = rest.agg(F.sum("size")).first()[0] or 0
    level, edge, edges = _level(loads, total), 0.0, []
    for x in loads:
        edge += max(0.0, level - x)
        edges.append(edge)
    cut = F.array(*[F.lit(float(e)) for e in edges[:-1]])
    middle = F.col("ahead") + F.col("size") / 2
    rest = _by_hash(rest, [], F.col("size"), n).withColumn("shard", F.size(F.filter(cut, lambda e: e <= middle))).drop("ahead")
    if not placed:
        return rest
    known = pool.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({u}L, {s})" for u, s in placed) + " AS t(uid, shard)")
    return rest.unionByName(pool.where(F.col("size") > large).join(F.broadcast(known), "uid"))


def _assigned(rows: DataFrame, scratch: Scratch, shards: int, rounds: int) -> DataFrame:
    """The rows of ``described`` with shard and slot."""
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    mean = (total or 0) / shards
    groups = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("group_size")).where("n > 1").drop("n")
    everywhere = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    marked = scratch.cut(rows.withColumn("salt", F.pmod("h", F.lit(SALT))).join(everywhere, ["group", "salt"], "left").drop("salt"), "marked")
    linked = propagate(marked.where("group_size IS NOT NULL"), scratch, shards, mean, n, rounds)
    loads = _loads(linked, shards)
    free = marked.where("group_size IS NULL")
    if max(loads) > mean:
        over = _by_group(linked, ["shard"], n).withColumn("over", F.col("ahead") + F.col("size") > F.lit(mean)).drop("ahead")
        over = scratch.cut(over, "over")
        free = free.unionByName(over.where("over").drop("over", "shard"))
        linked = over.where("NOT over").drop("over")
        loads = _loads(linked, shards)
    placed = scratch.cut(linked.unionByName(fill(free, loads, mean / LARGE, n)), "placed")
    return _by_hash(placed, ["shard"], F.lit(1), n // shards).withColumnRenamed("ahead", "slot")


def assign(docs: DataFrame, shards: int = 16, by: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null
    under this law) of each row of ``docs``.

    Size is the text's UTF-8 bytes plus 1; a null text has none, and is linked with
    empty texts.  Sizes of shards differ by about the largest document that was not
    among the large ones, where documents allow it.  ``by`` is a column whose equal
    values link documents (null is a value like any other).  Repeated rows and rows
    with null or equal ids are documents of their own.  An empty table gives an
    empty result; with fewer documents than shards some shards stay empty.  Runs
    over the same files agree.  Columns other than doc_id, text and those in ``by``
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    placed = _assigned(scratch.cut(described(docs, by), "rows"), scratch, shards, rounds)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(docs: DataFrame, shards: int = 16, by: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The documents themselves: document (a struct of all columns of ``docs``), shard
    and slot, a shard's rows in the order of its slots over one or more partitions.
    Awkward rows as in ``assign``."""
    scratch = Scratch(docs.sparkSession, "shards")
    kept = scratch.cut(docs.select(F.struct(*docs.columns).alias("document"), F.monotonically_increasing_id().alias("uid")), "documents")
    number = "uid" + "_" * max(map(len, docs.columns))
    rows = described(kept.select("document.*", F.col("uid").alias(number)), by, F.col(number))
    placed = _assigned(scratch.cut(rows, "rows"), scratch, shards, rounds).select("uid", "shard", "slot")
    return kept.join(placed, "uid").drop("uid").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
