"""Joins of links with what an archive or a local folder already holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import KEY_EXTENSIONS


def reconcile(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """Targets (url, key_base) with the first object, by extension, that is there:
    url, key, bytes.  listing: path, bytes."""
    tries = targets.select("url", F.posexplode(F.array(*[F.concat("key_base", F.lit(e)) for e in KEY_EXTENSIONS])).alias("at", "key"))
    hit = tries.join(listing.withColumnRenamed("path", "key"), "key")
    return hit.groupBy("url").agg(F.min_by(F.struct("key", "bytes"), "at").alias("b")).select("url", "b.key", "b.bytes")


def by_title(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (project, title, url) with the first file (project, title, path, ord)
    whose title has the same letters and digits."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    first = files.withColumn("t", bare("title")).where("t <> ''").groupBy("project", "t").agg(F.min_by("path", "ord").alias("path"))
    return links.withColumn("t", bare("title")).join(first, ["project", "t"]).select("url", "path")


def by_basename(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (url) with the last file (path, ord) of the same name, decoded, in lower case."""
    name = lambda c: F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"[^/]*$", 0), r"\+", "%2B")), F.lit("")))
    last = files.withColumn("n", name(F.col("path"))).groupBy("n").agg(F.max_by("path", "ord").alias("path"))
    return links.withColumn("n", name(F.col("url"))).where("n <> ''").join(last, "n").select("url", "path")


def rechecked(first: DataFrame, second: DataFrame, bad: Column) -> DataFrame:
    """Verdicts (url, verdict) after a second pass over the bad ones: confirmed where
    both passes agree, else the second verdict."""
    again = second.select("url", F.col("verdict").alias("v2"))
    j = first.join(again, "url", "left")
    confirmed = F.when(bad, F.coalesce(F.col("v2") == F.col("verdict"), F.lit(False)))
    return j.select("url", F.when(bad, F.coalesce("v2", "verdict")).otherwise(F.col("verdict")).alias("verdict"), confirmed.alias("confirmed"))


def unseen(found: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """What a resumed run still has to do."""
    return found.join(done.select(key).distinct(), key, "left_anti")
