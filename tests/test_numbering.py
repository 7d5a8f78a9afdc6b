"""Numbers of whole tables against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import numbering


@pytest.mark.parametrize(("n", "parts"), [(0, 3), (1, 3), (5000, 1), (5000, 7)])
def test_equal_to_sorting(spark, n, parts):
    """A third of the rows share the first key."""
    rng = random.Random(n)
    rows = [(0 if rng.random() < 0.33 else rng.choice([None, rng.randrange(50)]), i, rng.choice("xyz")) for i in rng.sample(range(n), n)]
    df = spark.createDataFrame(rows, "a long, b long, __id string")  # the column's own name stays
    got = numbering.numbered(df.withColumnRenamed("__id", "c"), [F.col("a").desc_nulls_last(), "b"], "n", parts)
    assert got.columns == ["a", "b", "c", "n"]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [tuple(r) for r in got.orderBy("n").collect()] == [(*r, i) for i, r in enumerate(want, 1)]


def test_hot_keys_are_split(spark):
    df = spark.range(8000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 8000).alias("v"))
    sizes = numbering.numbered(df, ["k", "v"], parts=4).groupBy(F.spark_partition_id()).count()
    assert numbering.numbered(df, ["k", "v"], parts=4).where("n <> v + 1").count() == 0 and sizes.count() >= 1


def test_plan_has_no_window_over_rows(spark):
    plan = numbering.numbered(spark.range(100), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 1 and "SinglePartition" in plan  # of the ranges' sizes


def test_shards(spark):
    got = [tuple(r) for r in numbering.shards(spark.range(10), ["id"], 4).orderBy("id").collect()]
    assert got == [(i, i // 4, i % 4) for i in range(10)]
