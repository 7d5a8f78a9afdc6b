"""Merges of manifests, shards and source blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Blocks of different columns under one another."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_precedence(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """``first``, and rows of ``second`` whose key it lacks; null keys all stay."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def merge_manifests(a: DataFrame, b: DataFrame, key: str = "url") -> DataFrame:
    """Full outer merge of two manifests (url, key, fetched_at, fails, doc_date).

    A record with a key beats one without, then the newer fetched_at wins, then
    a; fails is the larger; doc_date survives from either."""
    x, y = a.alias("x"), b.alias("y")
    j = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    has = lambda s: F.coalesce(F.nullif(F.col(f"{s}.key"), F.lit("")).isNotNull(), F.lit(False))
    newer = F.coalesce(F.col("y.fetched_at"), F.lit("")) > F.coalesce(F.col("x.fetched_at"), F.lit(""))
    second = F.col(f"x.{key}").isNull() | (F.col(f"y.{key}").isNotNull() & ((has("y") & ~has("x")) | ((has("x") == has("y")) & newer)))
    pick = lambda c: F.when(second, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c)
    other = lambda c: F.when(second, F.coalesce(F.col(f"y.{c}"), F.col(f"x.{c}"))).otherwise(F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}"))).alias(c)
    return j.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), pick("key"), pick("fetched_at"), F.greatest(F.coalesce("x.fails", F.lit(0)), F.coalesce("y.fails", F.lit(0))).alias("fails"), other("doc_date"))


def coalesce_parts(parts: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """For each key the first value that isn't empty of each field."""
    full = lambda c: F.min_by(F.col(c), F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.col(order))).alias(c)
    return parts.groupBy(key).agg(*map(full, fields))


def positional(extracted: DataFrame, shards: DataFrame, size: int, ident: str) -> tuple[DataFrame, DataFrame]:
    """Join labels to rows by position: shard * size + index = pos.  Returns the
    joined rows whose identifiers agree, and the rejects."""
    s = shards.withColumn("pos", F.col("shard") * size + F.col("index")).withColumnRenamed(ident, "label_ident")
    j = extracted.join(s.drop("shard", "index"), "pos", "left")
    good = F.col("label_ident") == F.col(ident)
    return j.where(good).drop("label_ident"), j.where(~F.coalesce(good, F.lit(False)))


def work_list(urls: DataFrame, manifest: DataFrame, give_up: int = 4) -> DataFrame:
    """Urls neither archived nor given up on; those without a record are due."""
    j = urls.join(manifest.select("url", "key", "fails"), "url", "left")
    return j.where(F.nullif(F.col("key"), F.lit("")).isNull() & (F.coalesce("fails", F.lit(0)) < give_up)).drop("key", "fails")


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found, key, "left_anti")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows added and removed between two snapshots, with their multiplicity."""
    add = after.exceptAll(before).withColumn("change", F.lit("added"))
    return add.unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


def without(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose column isn't the value; nulls stay."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(value)))
