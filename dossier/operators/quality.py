"""Data-quality checks as rows: level, check, item, message.

A check never raises for bad data; it reports.  ``fail`` and ``warn`` rows of all
checks are one table, so a run is clean if no fail is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.geo import in_canada
from .merge import union_all


#: Letters of a watched name that anchor its join.
ANCHOR = 4


def violations(rows: DataFrame, item: Column, checks: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """checks: (level, name, broken, message).  One pass over the rows."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("check"), message.cast("string").alias("message"))) for level, name, bad, message in checks]))
    return rows.select(item.cast("string").alias("item"), F.explode(found).alias("x")).select("x.level", "x.check", "item", "x.message")


def conditions(c: DataFrame) -> DataFrame:
    secondary = F.coalesce("discipline_secondary", F.array().cast("array<string>"))
    out = violations(
        c,
        F.col("condition_id"),
        [
            ("fail", "discipline", ~F.coalesce(F.col("discipline").isin(*rules.DISCIPLINES), F.lit(False)), F.col("discipline")),
            ("fail", "measure_type", ~F.coalesce(F.col("measure_type").isin(*rules.MEASURE_TYPES), F.lit(False)), F.col("measure_type")),
            ("fail", "timing", F.col("timing").isNotNull() & ~F.col("timing").isin(*rules.TIMINGS), F.col("timing")),
            ("fail", "secondary", ~F.forall(secondary, lambda s: s.isin(*rules.DISCIPLINES)), F.array_join(secondary, ",")),
            ("fail", "primary_in_secondary", F.array_contains(secondary, F.col("discipline")), F.col("discipline")),
            ("fail", "missing", F.col("project").isNull() | F.col("jurisdiction").isNull() | F.col("measure_text").isNull(), F.lit("missing key")),
        ],
    )
    again = c.withColumn("rn", F.row_number().over(Window.partitionBy("project", text.norm_text(F.col("measure_text"))).orderBy("ord"))).where("rn > 1")
    return out.unionByName(violations(again, F.col("condition_id"), [("warn", "repeated_text", F.lit(True), F.col("project"))]))


def features(f: DataFrame) -> DataFrame:
    """name, jurisdiction, lon, lat."""
    return violations(
        f,
        F.col("ord"),
        [
            ("fail", "name", F.nullif("name", F.lit("")).isNull(), F.lit("no name")),
            ("fail", "jurisdiction", F.nullif("jurisdiction", F.lit("")).isNull(), F.lit("no jurisdiction")),
            ("warn", "outside", F.col("lon").isNotNull() & ~in_canada(F.col("lon"), F.col("lat"), True), F.concat_ws(" ", "lon", "lat")),
        ],
    )


# Url shapes that are known to be dead.
BAD_URLS = (r"/050/evaluations/proj/[\w]+-", r"ree\.environnement\.gouv\.qc\.ca/fiche\.asp")


def urls(u: DataFrame, url: str = "url", bad: tuple[str, ...] = BAD_URLS) -> DataFrame:
    c = F.col(url)
    return violations(u, c, [("fail", "relative", ~F.coalesce(c.rlike("^https?://"), F.lit(False)), F.lit("no absolute url")), *[("fail", "known_bad", c.rlike(p), F.lit(p)) for p in bad]])


def catalogue(docs: DataFrame, key: str, url: str, title: str) -> DataFrame:
    """Urls that a catalogue lists twice fail; titles it repeats warn."""
    twice = docs.groupBy(key, url).count().where("count > 1")
    same = docs.groupBy(key, text.norm_title(F.col(title)).alias("t")).count().where("count > 1 and t <> ''")
    return union_all(
        [
            violations(twice, F.col(key), [("fail", "duplicate_url", F.lit(True), F.col(url))]),
            violations(same, F.col(key), [("warn", "same_title", F.lit(True), F.col("t"))]),
        ]
    )


def known_ladder(names: DataFrame, known: DataFrame) -> DataFrame:
    """For each known project (label, variant) the best level of any of its variants:
    3 a name equals it, 2 a name starts with it, 1 a name contains it, 0 none.
    Names meet variants on the variant's first ``ANCHOR`` letters, so neither side
    needs to be small; shorter variants, on all theirs."""
    low = F.lower("name")
    known = known.withColumn("__g", F.lower(F.substring("variant", 1, ANCHOR)))
    sizes = [r["n"] for r in known.select(F.length("__g").alias("n")).where("n > 0").distinct().collect()]  # at most ANCHOR of them

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - (n - 1), F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))

    runs = [runs_of(n) for n in sorted(sizes)]
    names = names.withColumn("__h", F.explode(F.array_distinct(F.concat(*runs)) if runs else F.array().cast("array<string>")))
    level = F.when(low == F.lower("variant"), 3).when(F.startswith(low, F.lower("variant")), 2).otherwise(1)
    hit = names.join(known, F.col("__h") == F.col("__g")).where(F.contains(low, F.lower("variant"))).groupBy("label").agg(F.max(level).alias("level"))
    return known.select("label").distinct().join(hit, "label", "left").select("label", F.coalesce("level", F.lit(0)).alias("level"))


def parity(index: DataFrame, features_: DataFrame, key: str) -> DataFrame:
    """Rows of both, distinct keys, and keys that only one has."""
    a, b = index.select(key).distinct(), features_.select(key).distinct()
    one = a.join(b, key, "left_anti").agg(F.count("*").alias("only_index"))
    two = b.join(a, key, "left_anti").agg(F.count("*").alias("only_features"))
    n = index.agg(F.count("*").alias("index_rows"), F.countDistinct(key).alias("index_keys"))
    m = features_.agg(F.count("*").alias("feature_rows"))
    return n.crossJoin(m).crossJoin(one).crossJoin(two)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("level", "check").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))


def least_rows(rows: DataFrame, item: str, least: int) -> DataFrame:
    """Fails where a table, such as a search index, has fewer rows than it should."""
    n = rows.agg(F.count("*").alias("n"))
    return violations(n, F.lit(item), [("fail", "index", F.col("n") < least, F.col("n"))])


def major_gaps(gaps: DataFrame, least: float = 1e9) -> DataFrame:
    """Warns of projects (name, verdict, value) of great value that nothing matches.  The
    value itself is compared; the message has it in whole numbers."""
    return violations(gaps, F.col("name"), [("warn", "major_gap", (F.col("verdict") == "gap") & (F.col("value") >= least), F.round("value").cast("long"))])


def predictions(p: DataFrame) -> DataFrame:
    """Fails for labels (id, discipline, measure_type, timing) outside their enums."""
    outside = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    checks = [("fail", "discipline", outside("discipline", rules.DISCIPLINES), F.col("discipline")), ("fail", "measure_type", outside("measure_type", rules.MEASURE_TYPES), F.col("measure_type"))]
    return violations(p, F.col("id"), [*checks, ("fail", "timing", F.col("timing").isNotNull() & outside("timing", rules.TIMINGS), F.col("timing"))])


def run_checks(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The rows of all checks.  One that can't even be planned is a failure of its
    own, named, with the error as message; the others still report.  What fails
    only as it runs ends the job, as a failed job does."""
    found = []
    for name, check in checks.items():
        try:
            found.append(check())
        except Exception as e:
            found.append(spark.createDataFrame([("fail", "crashed", name, f"{type(e).__name__}: {e}"[:500])], "level string, check string, item string, message string"))
    return union_all(found)
