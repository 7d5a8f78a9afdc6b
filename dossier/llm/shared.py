"""What the operators share: the folder for intermediate tables, lineage cuts,
connected components and small Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
SALT = 8


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a
    session on one machine may leave it unset and gets a temporary folder; on a
    cluster each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="dossier-"))
    return _own[0]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold for the tables written inside; the caller's come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Bound what one Arrow batch carries, since texts can be long.  What runs
    after the operator has returned has Spark's own bound of 64 MB a batch."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)})


class Scratch:
    """Tables of one operator in the shared folder.  Each is dropped when the
    operator calls ``drop``, or else when the driver's file system closes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._made = False

    def path(self, name: str) -> str:
        if not self._made:
            fs, at = _fs(self.spark, self.root)
            fs.mkdirs(at)
            fs.deleteOnExit(at)
            self._made = True
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write a frame as Parquet and read it back: lineage ends here, and a
        lost executor repeats nothing before it."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before, path = self.spark.conf.get(key, "false"), self.path(name)
        self.spark.conf.set(key, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, at = _fs(self.spark, f"{self.root}/{name}")
            fs.delete(at, True)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of edges (u, v): a row (node, component) for every
    node of an edge, the component being its smallest node.

    Alternates large-star and small-star steps, each a partial aggregate and a
    join, until the edges stay; every node then points at its minimum.  The edges
    of a node are dealt over ``SALT`` keys, and its minimum to each of them, so a
    node with very many meets it in several tasks.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.cut(e, f"{name}-0")
    digest = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    salted = lambda x: x.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)))
    everywhere = lambda x: x.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    mark, step = digest(e), 0
    while mark[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted(both).join(everywhere(least), ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large).join(everywhere(low), ["u", "salt"]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.where("x.v <> x.m").select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).distinct()
        step += 1
        e = scratch.cut(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = digest(e)
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(e.select("v", "v").distinct())


def trim() -> None:
    """Give memory that earlier tasks of this worker process have freed back to the
    system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of the column ``name``, for
    functions that run with whatever batches the caller's session makes."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(total[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()
