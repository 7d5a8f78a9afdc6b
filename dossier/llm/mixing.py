"""Mixing sources to target weights, with DataFrame functions only.

Targets come first, by water-filling.  The mix is ``shards * blocks`` quota units;
every source has its exact share of them by largest remainders.  A splitting tree
deals the units of all sources among the output shards: at every node they are
permuted by a keyed hash and cut at the exact size of the left half, so the counts
of the sources in each half are multivariate hypergeometric.

Then each unit draws its block of words.  A source's documents lie in one permuted
stream, as often as its target needs; the whole rounds of it are cut into blocks
that are all drawn, and from the last, partial round every unit draws one block of
its own stratum, by a hash of its shard.  Blocks never overlap and their words sum
to the target, rounded.  A shard shuffles what it has drawn by another hash.

No step sorts or sums a source as a whole: positions in a stream are prefix sums
over a radix tree of the permutation hash, 2 ** BITS children a node.  Only
metadata (sources, quota units) meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
BITS = 9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; 0 for null), key (hash of the text)
    and n, the number of rows that have all these."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    return rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """source, source_size, weight and target.

    Sources by code point, null last, take the weights in turn and share the sum
    of all sizes; none gets more than ``repeats`` times its size, and the excess
    goes to the others by weight until none is above.  Works on one row a source.
    """
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = sums.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(turn, ((F.col("at") - 1) % len(weights) + 1).cast("int")))
    # ascending by the level at which a source is full; all before the first that
    # isn't full at its own level are full
    level = Window.orderBy(F.col("source_size") / F.col("weight"), "at")
    through = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cap = F.col("source_size") * repeats
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(through), F.lit(0)))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(cap).over(through), F.lit(0)))
        .withColumn("open", F.col("rest") * F.col("weight") < cap * F.col("rest_weight"))
        .withColumn("level", F.first(F.when(F.col("open"), F.col("rest") / F.col("rest_weight")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0)))
    )
    target = F.when(F.col("level").isNull(), cap.cast("double")).otherwise(F.col("level") * F.col("weight"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def _permuted(sized: DataFrame, seed: int) -> DataFrame:
    """Adds ahead: the words of the documents before this one in its source's
    permuted stream."""
    h = F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"), F.col("key"))
    keyed = sized.withColumn("hash", h).withColumn("words", F.col("size") * F.col("n"))
    keyed = keyed.withColumn("top", F.shiftrightunsigned("hash", 64 - BITS)).withColumn("mid", F.shiftrightunsigned("hash", 64 - 2 * BITS))
    cells = keyed.groupBy("source", "top", "mid").agg(F.sum("words").alias("words"))
    tops = cells.groupBy("source", "top").agg(F.sum("words").alias("words"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("source").alias("s1"), F.col("top").alias("t1"), F.coalesce(F.sum("words").over(before("source", "top")), F.lit(0)).alias("top_ahead"))
    cells = cells.withColumn("in_top", F.coalesce(F.sum("words").over(before("source", "top", "mid")), F.lit(0)))
    cells = cells.join(tops, F.col("source").eqNullSafe(F.col("s1")) & (F.col("top") == F.col("t1")))
    cells = cells.select(F.col("source").alias("s2"), F.col("mid").alias("m2"), (F.col("in_top") + F.col("top_ahead")).alias("cell_ahead"))
    inside = Window.partitionBy("source", "mid").orderBy("hash", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("in_cell", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    placed = placed.join(cells, F.col("source").eqNullSafe(F.col("s2")) & (F.col("mid") == F.col("m2")))
    return placed.select("doc_id", "source", "size", "key", "n", (F.col("in_cell") + F.col("cell_ahead")).alias("ahead"))


def quotas(target: DataFrame, shards: int, blocks: int) -> DataFrame:
    """source, source_size, target, words (the target, rounded) and quota: how many
    of the mix's units the source has.  Every source with words to take has one at
    least; the others go by largest remainders, so that all sum to a multiple of
    ``shards``: ``shards * blocks``, or more where there are very many sources."""
    some = target.withColumn("words", F.round("target").cast("long")).where("words > 0")
    every = Window.partitionBy()
    units = F.lit(shards) * F.greatest(F.lit(blocks), F.ceil(F.count("*").over(every) * 4 / shards))
    part = some.withColumn("units", units.cast("long")).withColumn("sources", F.count("*").over(every))
    part = part.withColumn("share", F.col("words") / F.sum("words").over(every) * (F.col("units") - F.col("sources")))
    part = part.withColumn("floor", F.floor("share")).withColumn("place", F.row_number().over(every.orderBy(F.col("floor") - F.col("share"), "source")))
    more = F.when(F.col("place") <= F.col("units") - F.col("sources") - F.sum("floor").over(every), 1).otherwise(0)
    return part.select("source", "source_size", "target", "words", (F.col("floor") + 1 + more).cast("long").alias("quota"))


def deal_units(quota: DataFrame, shards: int, seed: int) -> DataFrame:
    """The rows of ``quota`` by unit (from 0 in its source), with its shard: the
    splitting tree.  Each node permutes its units by its own hash and sends the
    exact share of the left half's shards left."""
    rows = quota.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("unit"))
    rows = rows.withColumn("low", F.lit(0)).withColumn("high", F.lit(shards))
    width, depth = shards, 0
    while width > 1:
        node = Window.partitionBy("low", "high")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        rows = rows.withColumn("count", F.count("*").over(node)).withColumn("rank", F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(depth), "low", "high", "source", "unit"), "source", "unit")))
        left = F.col("rank") <= F.round(F.col("count") * (middle - F.col("low")) / (F.col("high") - F.col("low")))
        single = F.col("high") - F.col("low") <= 1
        rows = rows.withColumn("goes", F.when(single, 0).when(left, 1).otherwise(2)).withColumn("middle", middle)
        rows = rows.withColumn("low", F.when(F.col("goes") == 2, F.col("middle")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("goes") == 1, F.col("middle")).otherwise(F.col("high")))
        width, depth = (width + 1) // 2, depth + 1
    return rows.drop("count", "rank", "goes", "middle", "high").withColumnRenamed("low", "shard")


def draw_blocks(dealt: DataFrame, seed: int) -> DataFrame:
    """source, shard, start and length of each unit's block of words, zone and slot
    (where in the stream it lies: see ``_slots``) and the source's figures.

    A stream is the source's documents round after round.  ``rounds`` of them fit
    into the target as a whole: their ``full`` blocks are all drawn (zone 0).  The
    other units share the next round, cut into ``slots`` slots of ``width`` words
    (zone 1): each has a stratum of them and draws one.
    """
    rounds = F.floor(F.col("words") / F.col("source_size"))
    rows = dealt.withColumn("rounds", rounds).withColumn("order", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "unit"), "unit")) - 1)
    full = F.expr("(rounds * source_size * quota) div words")
    rows = rows.withColumn("whole", full).withColumn("edge", F.expr("(whole * words) div quota")).withColumn("rest", F.col("quota") - F.col("whole"))
    rows = rows.withColumn("width", F.expr("CASE WHEN rest > 0 THEN (words - edge + rest - 1) div rest ELSE 1 END"))
    rows = rows.withColumn("slots", F.expr("((rounds + 1) * source_size - edge) div width"))
    rows = rows.withColumn("full", F.expr(f"CASE WHEN rest > 0 AND slots >= rest AND rounds < {REPEATS} THEN whole ELSE quota END"))
    rows = rows.withColumn("zone", F.when(F.col("order") < F.col("full"), 0).otherwise(1)).withColumn("at", F.col("order") - F.col("full"))
    low, high = "((at * slots + rest - 1) div rest)", "(((at + 1) * slots + rest - 1) div rest)"
    pick = F.expr(f"{low} + pmod(xxhash64({seed + 3}, shard, source, unit), {high} - {low})")
    first = F.col("zone") == 0
    rows = rows.withColumn("slot", F.when(first, F.col("order")).otherwise(pick).cast("long"))
    rows = rows.withColumn("start", F.when(first, F.expr("(order * words) div quota")).otherwise(F.col("edge") + F.col("slot") * F.col("width")))
    length = F.when(first, F.expr("((order + 1) * words) div quota - (order * words) div quota")).otherwise(F.expr("((at + 1) * (words - edge)) div rest - (at * (words - edge)) div rest"))
    return rows.select("source", "source_size", "target", "words", "quota", "rounds", "full", "edge", "width", "slots", "shard", "zone", "slot", "start", length.alias("length"))


def _slots(first: str, last: str) -> Column:
    """(zone, slot) of all blocks that hold words ``first`` to ``last`` of a stream."""
    unit = lambda x: f"(({x} + 1) * quota - 1) div words"
    whole = f"CASE WHEN full > 0 AND {first} < words THEN filter(sequence({unit(first)}, least({unit(last)}, full - 1), 1L), x -> x < full) ELSE array() END"
    whole = f"CASE WHEN {unit(first)} <= least({unit(last)}, full - 1) THEN {whole} ELSE array() END"
    inner = f"CASE WHEN full < quota AND {last} >= edge THEN sequence(greatest({first} - edge, 0L) div width, ({last} - edge) div width, 1L) ELSE array() END"
    return F.expr(f"concat(transform({whole}, x -> struct(0 AS zone, x AS slot)), transform({inner}, x -> struct(1 AS zone, x AS slot)))")


class _Mix:
    """Figures of one mix, each written once."""

    def __init__(self, docs: DataFrame, shards: int, blocks: int, seed: int, weights: tuple[int, ...]):
        self.scratch, self.shards, self.seed = Scratch(docs.sparkSession, "mix"), shards, seed
        self.sized = self.scratch.cut(sizes(docs), "sizes")
        self.goal = self.scratch.cut(targets(self.sized, weights), "targets")
        self.drawn = self.scratch.cut(draw_blocks(deal_units(quotas(self.goal, shards, blocks), shards, seed), seed), "drawn")

    def copies(self) -> DataFrame:
        """doc_id, source, size, key, index (of equal rows), copy (round of the
        stream) and at, its first word's place, with the source's figures."""
        figures = ["source_size", "target", "words", "quota", "rounds", "full", "edge", "width"]
        per = self.drawn.groupBy(F.col("source").alias("s3")).agg(*(F.first(c).alias(c) for c in figures))
        placed = _permuted(self.sized.where("size > 0"), self.seed).join(per, F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
        rows = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("index"))
        last = F.least(F.col("rounds"), F.lit(REPEATS - 1)).cast("int")
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
        return rows.withColumn("at", F.col("ahead") + F.col("index") * F.col("size") + F.col("copy") * F.col("source_size"))

    def blocks(self, first: str, last: str) -> DataFrame:
        """Copies, once for each drawn block that holds some of their words from
        ``first`` to ``last``: begin, taken (of these words) and shard."""
        rows = self.copies().select("*", F.explode(_slots(first, last)).alias("x"))
        d = self.drawn.select(F.col("source").alias("s4"), F.col("zone").alias("z4"), F.col("slot").alias("b4"), "start", "length", "shard")
        met = rows.join(d, F.col("source").eqNullSafe(F.col("s4")) & (F.col("x.zone") == F.col("z4")) & (F.col("x.slot") == F.col("b4")))
        met = met.withColumn("begin", F.expr(f"greatest({first}, start)")).withColumn("taken", F.expr(f"least({last} + 1, start + length) - begin")).where("taken > 0")
        place = F.xxhash64(F.lit(self.seed + 1), "shard", "source", "doc_id", "key", "index", "copy", "begin")
        return met.withColumn("place", place).drop("s4", "z4", "b4", "x")


def mix(docs: DataFrame, shards: int = 16, blocks: int = 64, seed: int = 10, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix in words: a row for each part of a document that lies in one block.

    doc_id, source, size, source_size, target, copy (round of the stream, from 0),
    ahead (the part's place in the stream), words, zone and slot of the block,
    shard and place, the order in the shard.

    Documents without words are in no part.  Null sources are one source; null
    texts have no words; rows with a null id take part as any other.  Rows equal
    in id, source and text are documents of their own, one behind the other in the
    stream.  An empty table gives an empty result.  Reruns agree: all chance is
    hashes of ids and texts.  Columns other than doc_id, source and text are not
    read.
    """
    met = _Mix(docs, shards, blocks, seed, weights).blocks("at", "(at + size - 1)")
    return met.select("doc_id", "source", "size", "source_size", "target", "copy", F.col("begin").alias("ahead"), F.col("taken").alias("words"), "start", "shard", "place")


def taken(docs: DataFrame, shards: int = 16, blocks: int = 64, seed: int = 10, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix by document: a row for each row of ``docs`` with doc_id, source,
    size, source_size, target (its source's), taken (the words that drawn blocks
    hold of it, repeats counted; 0 if none) and shards (in how many shards they
    lie).  Awkward rows as in ``mix``; a row without words has 0 taken."""
    m = _Mix(docs, shards, blocks, seed, weights)
    key = ["doc_id", "source", "size", "key", "index"]
    every = m.sized.select("doc_id", "source", "size", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("index"))
    parts = m.blocks("at", "(at + size - 1)").select(*key, "taken", "shard")
    rows = every.select(*key, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("int").alias("shard")).unionAll(parts)
    sums = rows.groupBy(*key).agg(F.sum("taken").alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("shards"))
    g = m.goal.select(F.col("source").alias("s1"), "source_size", "target")
    return sums.join(g, F.col("source").eqNullSafe(F.col("s1"))).select("doc_id", "source", "size", "source_size", "target", "taken", "shards")


def mixed_documents(docs: DataFrame, shards: int = 16, blocks: int = 64, seed: int = 10, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``documents`` as the mix has them, whole: a row for each round in which a
    drawn block holds the document's middle word.  All columns stay.

    Rows of one shard come in its shuffled order, a shard's over one or more
    partitions.  Documents without words (null, empty) are in no block and go.
    Of rows equal in id, source and text, one stands for all: each is drawn on its
    own, with that one's other columns.  An empty table stays empty.
    """
    m = _Mix(docs, shards, blocks, seed, weights)
    middle = "(at + size div 2)"
    drawn = m.blocks(middle, middle).groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("key").alias("__k")).agg(F.collect_list(F.struct("shard", "place")).alias("__to"))
    drawn = m.scratch.cut(drawn, "copies")
    same = lambda a, b: F.col(a[0]).eqNullSafe(F.col(b[0])) & F.col(a[1]).eqNullSafe(F.col(b[1])) & (F.col(a[2]) == F.col(b[2]))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__d1"), F.col("source").alias("__s1"), F.xxhash64(F.col("text").cast("string")).alias("__k1"))
    equal = m.scratch.cut(m.sized.where("n > 1 and size > 0").select(F.col("doc_id").alias("__d2"), F.col("source").alias("__s2"), F.col("key").alias("__k2")), "equal")
    if equal.first() is not None:
        met = same(("__d1", "__s1", "__k1"), ("__d2", "__s2", "__k2"))
        one = rows.join(equal, met, "left_semi").groupBy("__d1", "__s1", "__k1").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
        rows = rows.join(equal, met, "left_anti").unionByName(one)
    both = rows.join(drawn, same(("__d1", "__s1", "__k1"), ("__d", "__s", "__k"))).select("__row", F.explode("__to").alias("__at"))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    piece = F.floor(F.shiftrightunsigned("__at.place", 32) / F.lit(1 << 32) * max(1, parts // shards))
    both = both.repartition(parts, F.col("__at.shard"), piece).sortWithinPartitions("__at.shard", "__at.place")
    return both.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
