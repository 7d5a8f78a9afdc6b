"""The relational tables seen as the domain's entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conditions(spark: SparkSession, d: str) -> DataFrame:
    """A line of an order is a condition: the customer its project, the market
    segment its archetype, the part's type its discipline, the flags its measure,
    the order's priority its timing and the region its jurisdiction."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(
        F.col("c_name").alias("project"),
        F.col("o_custkey").cast("string").alias("project_id"),
        F.col("c_mktsegment").alias("project_archetype"),
        F.col("r_name").alias("jurisdiction"),
        F.col("p_type").alias("discipline"),
        F.array("p_brand").alias("discipline_secondary"),
        F.concat("l_returnflag", "l_linestatus").alias("measure_type"),
        F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).alias("timing"),
        F.col("p_name").alias("measure_text"),
        F.col("l_orderkey").cast("string").alias("source_doc"),
        (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_partkey") % 1000000).alias("ord"),
    )


def lonlat(key: Column) -> tuple[Column, Column]:
    """A place in Canada for a key, by whole-number arithmetic."""
    return (-140.0 + (key * 7919) % 8700 / 100.0), (42.0 + (key * 104729) % 4100 / 100.0)


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Customers as projects: name, jurisdiction, place, type, proponent."""
    lon, lat = lonlat(F.col("c_custkey"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.col("r_name").alias("jurisdiction"), F.col("n_name").alias("source"), F.col("c_mktsegment").alias("type"), "c_acctbal", lon.alias("lon"), lat.alias("lat"))
