"""First, last and best rows of groups, numbering and disambiguation.

"First" always goes by explicit columns, never by the order rows happen to have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group; Spark cuts ranks ahead of the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) for c in order])


def first_per_group(df: DataFrame, keys: list[str], limit: int, order: list) -> DataFrame:
    """The first ``limit`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit).drop("__rn")


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def collision_suffix(df: DataFrame, key: str, order: list) -> DataFrame:
    """The key with one x more for each earlier row that has it."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("unique_id", F.concat(F.col(key), F.repeat(F.lit("x"), (n - 1).cast("int"))))


def merge_by_url(docs: DataFrame, url: str = "url", title: str = "title", order: str = "ord", fields: list[str] = ()) -> DataFrame:
    """One row for each url: the best title (first of equals), the first value that
    isn't empty of every other field, at the place of the first copy."""
    score = T.title_score(F.col(title))
    best = F.max_by(F.col(title), F.struct(score.alias("s"), (-F.col(order)).alias("o"))).alias(title)
    full = lambda c: F.min_by(F.col(c), F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.col(order))).alias(c)
    return docs.groupBy(url).agg(F.min(order).alias(order), best, *map(full, fields))


def prefer_named(docs: DataFrame, keys: list[str], title: str, order: str) -> DataFrame:
    """One row for each key: the first whose title isn't generic, else the first."""
    return keep_first(docs.withColumn("__g", T.generic_title(F.col(title)).cast("int")), keys, ["__g", order]).drop("__g")


def disambiguate(docs: DataFrame, keys: list[str], title: str, date: str, order: str, tags: list[Column]) -> DataFrame:
    """Suffixes titles that several rows of a group share.

    Rows that differ by date are told apart already.  Of the others, the first
    tag column is used that every row has, that differs among them and from the
    title; else "i of n".  Tagged titles are checked against all original titles
    of the group (not against those that other groups get by this).
    """
    norm = T.norm_title(F.col(title))
    d = docs.withColumn("__t", norm).withColumn("__d", F.coalesce(F.col(date), F.lit("")))
    same = Window.partitionBy(*keys, "__t", "__d")
    n = F.count("*").over(same)
    titles = d.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__t").alias("__taken")).distinct()
    usable = []
    for i, tag in enumerate(tags):
        d = d.withColumn(f"__tag{i}", F.nullif(tag, F.lit(""))).withColumn(f"__new{i}", T.norm_title(F.concat(F.trim(title), F.lit(" ("), F.col(f"__tag{i}"), F.lit(")"))))
        hit = titles.withColumnRenamed("__taken", f"__hit{i}")
        on = (F.col(f"__new{i}") == F.col(f"__hit{i}")) & F.lit(True)
        for j, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{j}"))
        d = d.join(hit, on, "left").drop(*[f"__k{j}" for j in range(len(keys))])
        fine = F.col(f"__tag{i}").isNotNull() & (T.norm_title(F.col(f"__tag{i}")) != F.col("__t")) & F.col(f"__hit{i}").isNull()
        d = d.withColumn(f"__fine{i}", F.min(fine.cast("int")).over(same) * (F.size(F.collect_set(f"__new{i}").over(same)) == n).cast("int"))
        usable.append(F.when(F.col(f"__fine{i}") == 1, F.col(f"__tag{i}")))
    at = F.row_number().over(same.orderBy(order))
    tag = F.coalesce(*usable, F.concat(at, F.lit(" of "), n))
    named = F.when((n > 1) & (F.col("__t") != ""), F.concat(F.trim(title), F.lit(" ("), tag, F.lit(")"))).otherwise(F.col(title))
    return d.withColumn("new_title", named).select(*docs.columns, "new_title")


def every_nth(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") % n == 0).drop("__rn")


def round_robin(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds turn and place: rows of all groups in turn, groups by their first row."""
    w = Window.partitionBy(key)
    return df.withColumn("turn", F.row_number().over(w.orderBy(order))).withColumn("place", F.min(order).over(w))


def duplicate_mass(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many groups have several rows, and how many rows are beyond the first."""
    n = df.groupBy(*keys).count().where("count > 1")
    return n.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows_shared"))
