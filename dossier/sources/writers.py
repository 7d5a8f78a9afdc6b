"""Writers.  Parquet is the product; JSON exports are for the site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .commits import archive, feature_collection, raster  # noqa: F401  they act at commit


def compact_index(rows: DataFrame, names: dict[str, str], path: str) -> None:
    """JSON lines under short names, without nulls."""
    rows.select(*[F.col(k).alias(v) for k, v in names.items()]).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def one_per_key(rows: DataFrame, key: str, path: str) -> None:
    """A folder of files for each key."""
    rows.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def index_table(ix: DataFrame, path: str, parts: int = 16) -> None:
    """An inverted index, sorted by term, so that a term reads few row groups."""
    ix.repartitionByRange(parts, "term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(path)


def if_changed(rows: DataFrame, path: str) -> bool:
    """Overwrite a Parquet table only where rows differ; whether it was written.
    The new table is written beside the old one, the old one stepped aside and the
    new one moved in: a crash leaves one of them under ``path`` or beside it
    (``.next``, ``.last``), and the next call starts from what is there."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    beside, last = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in (".next", ".last"))
    if not fs.exists(at) and fs.exists(last):
        fs.rename(last, at)  # a crash between the two moves
    if fs.exists(at):
        old = spark.read.parquet(path)
        if old.columns == rows.columns and rows.exceptAll(old).isEmpty() and old.exceptAll(rows).isEmpty():
            return False
    rows.write.mode("overwrite").parquet(f"{path}.next")
    fs.delete(last, True)
    if fs.exists(at) and not fs.rename(at, last):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(beside, at):
        raise OSError(f"{path}.next can't be moved")
    fs.delete(last, True)
    return True


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def review(frames: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV sheets."""
    for name, df in frames.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
