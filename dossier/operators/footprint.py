"""Entities: aliases, footprints, public bodies, tiers and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# First words of public bodies, which always exclude a name, other words
# of public bodies and of names that are no company's, and words that keep such a name.
LEADS = (
    "department", "ministry", "minist[èe]re", "city", "town", "village", "municipality", "county", "region", "district",
    "province", "government", "her majesty", "his majesty", "crown",
)
BODIES = (
    "department", "ministry", "minist[èe]re", "parks canada", "fisheries", "oceans canada", "canada border", "coast guard",
    "national capital", "transport canada", "correctional", "environment and climate", "national defence", "dnd", "pspc",
    "public services", "rcmp", "royal canadian", "canada post", "nav canada", "agriculture and agri", "national research",
    "city of", "town of", "village of", "municipality", "county", "region of", "regional", "district of", "township",
    "first nation", "nation", "band", "tribal", "province of", "government", "agency", "secretariat",
    "infrastructure canada", "indigenous services", "crown-indigenous", "natural resources canada", "nrcan", "health canada",
    "statistics", "revenue", "library", "museum", "school", "university", "college", "hospital", "health",
    "conservation authority", "external proponent", "external", "not applicable", "upland owner", "security",
    "transportation", "ducks unlimited", "telus", "bell canada", "rogers", "shaw", "airport", "a[ée]roport",
    "port authority", "airports", "metro vancouver", "translink", "commission",
)
COMPANIES = (
    "hydro", "power", "energy", "generation", "nuclear", "mines?", "mining", "gold", "lithium", "nickel", "iron", "potash",
    "uranium", "lng", "pipeline", "resources",
)
LEAD_PUBLIC = rf"(?iU)^\s*(the\s+)?({'|'.join(LEADS)})\b"
PUBLIC = rf"(?iU)\b({'|'.join(BODIES)})\b"
KEEP = rf"(?iU)\b({'|'.join(COMPANIES)})\b"


def is_public(name: Column) -> Column:
    """Whether a name is a public body's: by its first words always, by others unless
    a company's word stands beside them."""
    return name.rlike(LEAD_PUBLIC) | (name.rlike(PUBLIC) & ~name.rlike(KEEP))


def footprint(rows: DataFrame) -> DataFrame:
    """key, variant, projects, docs, value, source to one row a key: sums, variants by
    frequency, and score = 3 projects + 0.05 docs + value / 1e8."""
    by = rows.groupBy("key", "variant").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    best = by.groupBy("key").agg(F.max_by("variant", F.struct((text.norm_company(F.col("variant")) == F.col("key")).alias("same"), "n", (-F.col("o")).alias("o"))).alias("name"), F.count("*").alias("variants"))
    total = rows.groupBy("key").agg(F.sum("projects").alias("projects"), F.sum("docs").alias("docs"), F.sum("value").alias("value"))
    score = F.round(3 * F.col("projects") + 0.05 * F.col("docs") + F.col("value") / 1e8, 1)
    return total.join(best, "key").withColumn("score", score)


def apply_aliases(rows: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Keys with the canonical name of the first alias (alias, canonical, ord) that is
    the key itself, else of the first that occurs in it as words.  Keys meet
    aliases on the alias's first word, so neither side needs to be small."""
    words = F.explode(F.array_distinct(F.split(key, " ")))
    keys, first_word = rows.select(key).distinct().withColumn("__w", words), F.split("alias", " ")[0]
    whole = F.concat(F.lit(" "), F.col(key), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("alias"), F.lit(" ")))
    hit = keys.join(aliases.withColumn("__a", first_word), F.col("__w") == F.col("__a")).where(whole)
    first = hit.groupBy(key).agg(F.min_by("canonical", F.struct((F.col("alias") != F.col(key)).alias("part"), "ord")).alias("canonical"))
    return rows.join(first, key, "left").withColumn("canonical", F.coalesce("canonical", key))


def facet_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """facet, value and n of several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def facet_filter(rows: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """All facets must agree; within one any value does, None for a missing one."""
    for name, values in chosen.items():
        some = [v for v in values if v is not None]
        ok = F.col(name).isin(some) if some else F.lit(False)
        rows = rows.where(ok | F.col(name).isNull() if None in values else ok)
    return rows


def relaxations(rows: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """How many rows would be left without each one of the facets."""
    out = None
    for drop in chosen:
        n = facet_filter(rows, {k: v for k, v in chosen.items() if k != drop}).agg(F.count("*").alias("n")).select(F.lit(drop).alias("dropped"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def funnel(rows: DataFrame, key: str, steps: dict[str, Column]) -> DataFrame:
    return rows.groupBy(key).agg(*[F.count_if(c).alias(name) for name, c in steps.items()])


def reason(rules: list[tuple[Column, str]], fallback: str) -> Column:
    """The first failing rule's reason."""
    out = None
    for bad, why in rules:
        out = F.when(bad, why) if out is None else out.when(bad, why)
    return out.otherwise(fallback)


def section_relabel(docs: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Adds relabel: whether a section has several documents, all approvals or approvals and amendments."""
    w = Window.partitionBy(*keys)
    kinds = F.array_join(F.array_sort(F.collect_set(kind).over(w)), ",")
    return docs.withColumn("relabel", kinds.isin("approval", "amendment,approval") & (F.count("*").over(w) > 1))
