"""Manifest upserts and retry counting, incrementally.

A lane reads new probe rows as they land, folds each batch into a manifest table
and can stop and resume at any batch: the manifest of a batch is written beside
the old one under the batch's number, and a pointer-free reader takes the highest
number there is, so a batch that runs again writes the same table again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import merge_manifests

MANIFEST = "url string, key string, fetched_at string, fails int, doc_date string"


def latest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not done:
        return -1, spark.createDataFrame([], MANIFEST)
    return max(done), spark.read.schema(MANIFEST).parquet(f"{path}/v={max(done)}")


def fold(probes: DataFrame) -> DataFrame:
    """Probes (url, ok, ts, key, doc_date) of one batch to one record a url: the
    newest success, and how many failures came."""
    good = F.when(F.col("ok"), F.struct("ts", "key"))
    agg = probes.groupBy("url").agg(F.max(good).alias("g"), F.count_if(~F.col("ok")).cast("int").alias("fails"), F.max("doc_date").alias("doc_date"))
    return agg.select("url", F.col("g.key").alias("key"), F.col("g.ts").cast("string").alias("fetched_at"), "fails", "doc_date")


def add_failures(manifest: DataFrame, batch: DataFrame) -> DataFrame:
    """merge_manifests, with failures of the batch added to those known; a success
    clears them."""
    merged = merge_manifests(manifest, batch)
    old = manifest.select("url", F.col("fails").alias("old"))
    new = batch.select("url", F.col("fails").alias("new"), F.col("key").isNotNull().alias("ok"))
    j = merged.join(old, "url", "left").join(new, "url", "left")
    total = F.when(F.coalesce("ok", F.lit(False)), 0).otherwise(F.coalesce("old", F.lit(0)) + F.coalesce("new", F.lit(0)))
    return j.select("url", "key", "fetched_at", total.cast("int").alias("fails"), "doc_date")


def manifest_lane(probes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of probes into the manifest under ``path``; runs until what
    has landed is done."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known, manifest = latest(spark, path)
        if number <= known:
            manifest = spark.read.schema(MANIFEST).parquet(f"{path}/v={number - 1}") if number else spark.createDataFrame([], MANIFEST)
        add_failures(manifest, fold(batch)).write.mode("overwrite").parquet(f"{path}/v={number}")

    return probes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_filings(rows: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """The first sight of each key, remembered as long as rows may come late."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def hourly(rows: DataFrame, time: str, key: str, late: str = "1 hour") -> DataFrame:
    """Counts by hour and key, final once the watermark has passed."""
    return rows.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), key, "n")
