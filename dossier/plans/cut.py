"""Lineage cuts of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.  A session
    on one machine may leave it unset and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="dossier-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once, written as a table into the shared folder and read
    back: no plan grows from round to round, and a lost executor repeats nothing before
    the cut.  Tables go when the driver's file system closes."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/cut-{uuid.uuid4().hex[:16]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
