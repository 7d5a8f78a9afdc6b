"""What the vector searches share: reading vectors, collapsing equal ones and
the final ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_EVERY = 50


def sound(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    limit = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def one_length(rows: DataFrame, vector: str) -> DataFrame:
    """Only the vectors of the most frequent length; of equally frequent, the longer."""
    sizes = rows.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows"))
    usual = sizes.agg(F.max_by("n", F.struct("rows", "n"))).first()[0]
    return rows.where(F.size(vector) == (usual or 0))


def collapse(rows: DataFrame, vector: str, keep: int) -> DataFrame:
    """One row for each distinct vector: rep (its smallest id), ids (its ``keep``
    smallest, ascending) and the vector.  Equal vectors score alike, and ties go
    to smaller ids, so no others can be among the first keep - 1 of a query that
    leaves itself out.  Ranks are cut ahead of the shuffle, so a vector that many
    rows share never meets in one task as a whole."""
    order = Window.partitionBy(vector).orderBy("vec_id")
    few = rows.select("vec_id", vector).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep)
    return few.groupBy(vector).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", vector)


def rank(found: DataFrame, k: int) -> DataFrame:
    """(query_id, ids, score) to the k best (query_id, rank, vec_id, score)."""
    flat = found.dropDuplicates(["query_id", "rep"]).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """An Arrow list column, all lists equally long, as a matrix."""
    n = len(column)
    if not n:
        return np.zeros((0, 0), dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1)
