"""How far the sources of a language lie from one another, and by which terms.

Every group (lang, source), and every language, gives each kept term of the language
a smoothed share p in billionths.  Most terms are in few sources: a pair of sources
starts from the divergence of two absent terms, times the number of terms.  Terms of
one side correct that through how many terms the side has of each count; only terms
that both have meet in a join, on the term, and each of its pairs once.

The terms of a group that stand out most are found by radix selection.  Histograms
over digits of the value, from the highest, find in which bucket the kth value lies;
ties at the kth value are refined by the bytes of the term in the same way.  A group's
terms are never sorted together, only those that are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

# What a term is, once A-Z are lower-cased, and the scale of shares.
TERM = r"[^\x00-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Values lie below 2 ** 60; a digit has 15 of these bits, or 8 bytes of a term.
BITS, DIGIT, BYTES = 60, 15, 8
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(clean("lang").alias("lang"), clean("source").alias("source"), F.regexp_extract_all(F.translate(clean("text"), UPPER, LOWER), F.lit(TERM), F.lit(0)).alias("terms"))
    # behind all occurrences come the document's distinct terms, once each
    each = rows.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    first = F.col("at") < F.col("size")
    return each.groupBy("lang", "source", "term").agg(F.sum(F.when(first, 1).otherwise(0)).alias("n"), F.sum(F.when(first, 0).otherwise(1)).alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a term with ``n`` of ``total`` occurrences among ``kept`` terms, exactly."""
    wide = (n + F.lit(1)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", wide, (total + kept).cast("decimal(20,0)")) + 1)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, total, kept, base) and the kept terms that they have
    (lang, source, term, n, p, base and q, the language's p)."""
    counts = scratch.cut(term_counts(docs), "counts")
    term = Window.partitionBy("lang", "term")
    kept = counts.withColumn("lang_n", F.sum("n").over(term)).withColumn("df", F.sum("docs").over(term))
    kept = kept.withColumn("one", F.when(F.col("source") == F.min("source").over(term), 1).otherwise(0)).where(F.col("df") >= least)
    kept = scratch.cut(kept.select("lang", "source", "term", "n", "lang_n", "one"), "kept")
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    every = docs.select(clean("lang"), clean("source")).distinct().withColumns({"n": F.lit(0).cast("long"), "one": F.lit(0).cast("long")})
    groups = every.unionByName(kept.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.sum("one").alias("one")))
    groups = groups.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.sum("one").alias("one"))
    whole = Window.partitionBy("lang")
    groups = groups.withColumn("lang_total", F.sum("total").over(whole)).withColumn("kept", F.sum("one").over(whole)).drop("one")
    groups = scratch.cut(groups.withColumn("base", share(F.lit(0), F.col("total"), F.col("kept"))), "groups")
    met = kept.join(groups, GROUP)
    met = met.select("lang", "source", "term", "n", "base", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return groups, scratch.cut(met, "shares")


def divergence(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item (every other source of the language) and value: the sum of
    ``apart`` over all kept terms, those included that neither has."""
    side = lambda s, cols: groups.select("lang", *(F.col(c).alias(c + s) for c in cols))
    absent = F.coalesce(apart(F.col("base"), F.col("base2")), F.lit(0))
    start = side("", ["source", "base", "kept"]).join(side("2", ["source", "base"]), "lang").where("source <> source2")
    start = start.select("lang", "source", F.col("source2").alias("item"), (absent * F.col("kept")).alias("value"))
    # terms of one side alone, by their counts
    levels = terms.groupBy("lang", "source", "n", "p", "base").agg(F.count("*").alias("m"))
    met = levels.join(side("2", ["source", "base"]), "lang").where("source <> source2")
    own = (apart(F.col("p"), F.col("base2")) - absent) * F.col("m")
    other = (apart(F.col("base2"), F.col("p")) - apart(F.col("base2"), F.col("base"))) * F.col("m")
    single = met.groupBy("lang", "source", "source2").agg(F.sum(own).alias("own"), F.sum(other).alias("other"))
    # terms of both: what the two corrections above miss
    a = terms.select("lang", "term", "source", "p", "base")
    b = terms.select("lang", "term", F.col("source").alias("source2"), F.col("p").alias("p2"), F.col("base").alias("base2"))
    both = a.join(b, ["lang", "term"]).where("source < source2")
    excess = lambda p, base, p2, base2: apart(p, p2) - apart(p, base2) - apart(base, p2) + apart(base, base2)
    c = [F.col(x) for x in ("p", "base", "p2", "base2")]
    both = both.groupBy("lang", "source", "source2").agg(F.sum(excess(*c)).alias("own"), F.sum(excess(*c[2:], *c[:2])).alias("other"))
    parts = single.unionByName(both)
    parts = parts.select("lang", F.explode(F.array(F.struct("source", F.col("source2").alias("item"), F.col("own").alias("value")), F.struct(F.col("source2").alias("source"), F.col("source").alias("item"), F.col("other").alias("value")))).alias("x"))
    return start.unionByName(parts.select("lang", "x.*")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _bucket(counted: DataFrame, keys: list[str], digit: Column) -> DataFrame:
    """Of each key's histogram, the bucket in which the ``need``-th row lies, with
    the rows still needed from it; ``whole`` if it is needed as a whole.  Keys with
    too few rows have their last bucket whole."""
    order = Window.partitionBy(*keys).orderBy(digit)
    rows = counted.withColumn("through", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("left", F.lead("n").over(order).isNotNull())
    rows = rows.where((F.col("through") - F.col("n") < F.col("need")) & ((F.col("through") >= F.col("need")) | ~F.col("left")))
    return rows.withColumn("whole", F.col("through") <= F.col("need")).withColumn("need", F.col("need") - F.col("through") + F.col("n")).drop("through", "left", "n")


def radix_top(rows: DataFrame, keys: list[str], k: int, scratch: Scratch) -> DataFrame:
    """The rows (keys, item string, value long of 0 to 2 ** 60 - 1) that are among the
    first k of their keys by value descending and item ascending by its bytes.  Items
    of equal keys and value are distinct."""
    shift = BITS - DIGIT
    counted = rows.groupBy(*keys, F.shiftright("value", shift).alias("prefix")).agg(F.count("*").alias("n")).withColumn("need", F.lit(k).cast("long"))
    state = _bucket(counted, keys, F.col("prefix").desc()).withColumn("shift", F.lit(shift))
    state = scratch.cut(state, "digit-0")
    # what may still be among the first k: no more than k rows and the bucket
    cand = scratch.cut(rows.join(state.select(*keys, "prefix"), keys).where(F.shiftright("value", shift) >= F.col("prefix")).drop("prefix"), "candidates")
    step = 0
    while shift and state.where("NOT whole").first() is not None:
        shift, step = shift - DIGIT, step + 1
        open_ = cand.join(state.where("NOT whole"), keys).where(F.shiftright("value", shift + DIGIT) == F.col("prefix"))
        counted = open_.groupBy(*keys, F.shiftright("value", shift).alias("at"), "need").agg(F.count("*").alias("n"))
        found = _bucket(counted, keys, F.col("at").desc()).withColumn("shift", F.lit(shift)).withColumnRenamed("at", "prefix")
        state = scratch.cut(state.where("whole").unionByName(found), f"digit-{step}")
    state = state.withColumn("bytes", F.lit(None).cast("binary"))
    width, binary = 0, F.col("item").cast("binary")
    while state.where("NOT whole").first() is not None:
        width, step = width + BYTES, step + 1
        head = lambda n: F.substring(binary, 1, n)  # noqa: E731, B023
        open_ = cand.join(state.where("NOT whole"), keys).where(F.expr("shiftright(value, shift) = prefix"))
        if width > BYTES:
            open_ = open_.where(head(width - BYTES) == F.col("bytes"))
        counted = open_.groupBy(*keys, "prefix", "shift", "need", head(width).alias("at")).agg(F.count("*").alias("n"))
        found = _bucket(counted, keys, F.col("at").asc()).withColumnRenamed("at", "bytes")
        state = scratch.cut(state.where("whole").unionByName(found), f"bytes-{step}")
    met = cand.join(state.select(*keys, "prefix", "shift", "bytes"), keys)
    level = F.expr("shiftright(value, shift)")
    inside = F.col("bytes").isNull() | (F.expr("substring(cast(item AS binary), 1, length(bytes))") <= F.col("bytes"))
    return met.where((level > F.col("prefix")) | ((level == F.col("prefix")) & inside)).select(*keys, "item", "value")


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair``: for each source of a language its divergence from every other one,
    all ranks.  Part ``term``: the first ``top`` terms that a source has more of than
    its language, by how far.  Kept terms are those in at least ``least`` documents of
    the language.  Null texts, languages and sources are empty ones; each row is a
    document, repeated or not; ids are not read.  A group without terms takes part in
    pairs; without kept terms the language's pairs have the value 0.  An empty table
    gives an empty result.  Columns other than text, lang and source are not read.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    groups, terms = shares(docs, least, scratch)
    pairs = divergence(groups, terms).withColumn("part", F.lit("pair"))
    above = terms.where("p > q").select(*GROUP, F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    named = radix_top(above, GROUP, top, scratch).withColumn("part", F.lit("term"))
    rows = pairs.unionByName(named)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
