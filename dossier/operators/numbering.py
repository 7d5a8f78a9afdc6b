"""Positions in the order of a whole table, without a window over all of it.

Rows are dealt over ranges of the order and sorted within; a range's rows know their
place in it, and the sizes of the ranges before say where it starts.  Ranges take all
columns of the order, so rows that are equal in the first ones are split like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut

#: Places of a range, below the number of the range, in a row's id.
_PLACES = 33


def numbered(rows: DataFrame, order: list[str | Column], name: str = "n", parts: int | None = None) -> DataFrame:
    """Adds ``name``, from 1 on, by ``order``; which of rows that are equal in all of it
    comes first is open.  The sizes of the ranges alone meet in one task."""
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__id", _PLACES)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    met = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")  # as many rows as ranges
    return met.withColumn(name, F.col("__start") + F.col("__id").bitwiseAND((1 << _PLACES) - 1) + 1).drop("__id", "__part", "__start")


def shards(rows: DataFrame, order: list[str | Column], size: int) -> DataFrame:
    """Adds shard and index: the place in files of ``size`` rows, both from 0."""
    place = F.col("__n") - 1
    return numbered(rows, order, "__n").select(*rows.columns, F.floor(place / size).alias("shard"), (place % size).alias("index"))
