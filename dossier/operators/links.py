"""Link audits: roll-ups, caps per host, canaries and dead hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The verdicts of a probe.
VERDICTS = ("ok", "soft404", "http_error", "error", "js_app", "index_verified", "skipped")


def rollup(probes: DataFrame, key: str, verdict: str, values: list[str], broken: list[str]) -> DataFrame:
    """Counts by key and verdict, with total, broken and its share; and a row of
    totals under the key "total"."""
    wide = probes.groupBy(key).agg(*[F.count_if(F.col(verdict) == v).alias(v) for v in values], F.count("*").alias("total"))
    whole = probes.agg(*[F.count_if(F.col(verdict) == v).alias(v) for v in values], F.count("*").alias("total")).withColumn(key, F.lit("total"))
    both = wide.withColumn(key, F.col(key).cast("string")).unionByName(whole)
    bad = sum((F.col(v) for v in broken), F.lit(0))
    return both.withColumn("broken", bad).withColumn("share", F.when(F.col("total") > 0, F.round(bad / F.col("total"), 6)))


def host_cap(urls: DataFrame, host: str, order: str, cap: int) -> DataFrame:
    """Rows beyond the first ``cap`` of a host get the verdict index_verified."""
    rn = F.row_number().over(Window.partitionBy(host).orderBy(order))
    return urls.withColumn("verdict", F.when(rn > cap, "index_verified"))


def dead_hosts(probes: DataFrame, host: str, order: str, ok: Column, run: int = 3) -> DataFrame:
    """Adds dead: whether the ``run`` probes of the host before this one all failed."""
    w = Window.partitionBy(host).orderBy(order).rowsBetween(-run, -1)
    return probes.withColumn("dead", (F.count("*").over(w) == run) & (F.sum(ok.cast("int")).over(w) == 0))


def health(probes: DataFrame, broken, alarm: float = 0.02) -> DataFrame:
    return probes.agg(F.avg(broken.cast("double")).alias("share")).withColumn("alarm", F.col("share") > alarm)
