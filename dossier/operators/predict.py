"""Precedent registers over a pool of conditions.

A pool has project, project_id, project_archetype, jurisdiction, discipline,
discipline_secondary (array), measure_type, timing, measure_text, source_doc, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(disciplines: list[str]) -> Column:
    """Whether a condition counts for a fired discipline, first or secondary."""
    wanted = F.array(*map(F.lit, disciplines)) if disciplines else F.array().cast("array<string>")
    return F.array_contains(wanted, F.col("discipline")) | F.coalesce(F.arrays_overlap("discipline_secondary", wanted), F.lit(False))


def register(pool: DataFrame, archetype: str, disciplines: list[str], jurisdictions: list[str] | None = None, strong: bool = True) -> DataFrame:
    """Measures by how many comparable projects carry them.

    Groups by discipline and measure type; (other, other) never counts.  The
    numerator counts distinct projects, the denominator distinct project ids (or
    names) of the archetype in the whole pool, at least 1.  typical_timing is the
    most frequent timing, of equals the one seen first.  All figures but the
    denominator are taken from one pre-aggregate; Spark reuses its exchange.
    """
    pool = pool if not jurisdictions else pool.where(F.col("jurisdiction").isin(jurisdictions))
    same = F.col("project_archetype") == archetype
    base = pool.where(same).agg(F.greatest(F.countDistinct(F.coalesce(F.nullif("project_id", F.lit("")), F.col("project"))), F.lit(1)).alias("n_base"))
    rows = pool.where((same if strong else ~same) & hits(disciplines) & ~((F.col("discipline") == "other") & (F.col("measure_type") == "other")))
    key = ["discipline", "measure_type"]
    # all figures come from one partial aggregate, by project, timing and jurisdiction
    cells = rows.groupBy(*key, "project", "timing", "jurisdiction").agg(F.count("*").alias("n"), F.min(F.when(F.col("ord").isNotNull(), F.struct("ord", F.substring("measure_text", 1, 300).alias("text"), "source_doc"))).alias("first"))
    groups = cells.groupBy(*key).agg(F.countDistinct("project").alias("precedent_projects"), F.min("first").alias("first"))
    groups = groups.select(*key, "precedent_projects", F.col("first.ord").alias("first_ord"), F.col("first.text").alias("sample_condition"), F.col("first.source_doc").alias("sample_source"))
    few = cells.select(*key, "project").distinct().withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy("project"))).where("__rn <= 4")
    examples = few.groupBy(*key).agg(F.array_sort(F.collect_list("project")).alias("examples"))
    timing = cells.where(F.coalesce("timing", F.lit("")) != "").groupBy(*key, "timing").agg(F.sum("n").alias("n"), F.min("first.ord").alias("o"))
    typical = timing.groupBy(*key).agg(F.max_by("timing", F.struct("n", (-F.col("o")).alias("o"))).alias("typical_timing"))
    where = cells.groupBy(*key, "jurisdiction").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("jurisdiction", "n")))).alias("jurisdictions"))
    out = groups.join(examples, key).join(typical, key, "left").join(where, key).crossJoin(F.broadcast(base))
    frequency = F.concat(F.col("precedent_projects").cast("string"), F.lit("/"), F.col("n_base").cast("string"), F.lit(" comparable projects"))
    return out.withColumn("frequency", frequency).drop("n_base").orderBy(F.desc("precedent_projects"), "first_ord")


def fingerprint(pool: DataFrame, project: Column) -> DataFrame:
    """A project's obligations by discipline, most first."""
    return pool.where(project).groupBy("discipline").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "discipline")


def compare(pool: DataFrame, projects: list[str]) -> DataFrame:
    """Disciplines by up to four projects."""
    wide = pool.where(F.col("project").isin(projects)).groupBy("discipline").pivot("project", projects).agg(F.count("discipline"))
    return wide.select("discipline", *[F.coalesce(F.col(p), F.lit(0)).alias(f"p{i}") for i, p in enumerate(projects)])


def priors_overlay(priors: DataFrame, found: DataFrame) -> DataFrame:
    """Expected pairs, flagged where no precedent supports them."""
    keys = ["discipline", "measure_type"]
    return priors.join(found.select(*keys, "precedent_projects"), keys, "left").withColumn("flag", F.when(F.col("precedent_projects").isNull(), "expected (no precedent match yet)"))


def top_above(rows: DataFrame, value: str, least: float, limit: int, order: list) -> DataFrame:
    """The ``limit`` greatest values of ``least`` and more."""
    return rows.where(F.col(value) >= least).orderBy(F.desc(value), *order).limit(limit)


def top_counts(rows: DataFrame, key: str, limit: int, **more: Column) -> DataFrame:
    """The ``limit`` most frequent values of a key, with further aggregates."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in more.items()]).orderBy(F.desc("n"), key).limit(limit)


def recurring(rows: DataFrame, column: str, mapped: list[str], least: int = 3) -> DataFrame:
    """Values that no rule maps and that recur: value and n, for promotion."""
    known = F.col(column).isin(*mapped) if mapped else F.lit(False)
    return rows.where(F.col(column).isNotNull() & ~known).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def by_timing(pool: DataFrame) -> DataFrame:
    """Conditions and disciplines of each timing, none for a missing one."""
    return pool.groupBy(F.coalesce("timing", F.lit("none")).alias("timing")).agg(F.count("*").alias("n"), F.countDistinct("discipline").alias("disciplines"))
