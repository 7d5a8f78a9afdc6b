"""The project table end to end: union, categories, places, enrichment, ids and process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.geo import in_canada
from ..operators import dedupe, merge, spatial


def assemble(blocks: list[DataFrame], gazetteer: DataFrame | None = None, enrichment: DataFrame | None = None) -> DataFrame:
    """Blocks (ord, name, jurisdiction, ...) to one table with category, place and id.

    Places: a row's own point if it lies in Canada, else the gazetteer's (with
    geocode set), else the enrichment's (jurisdiction, name, proponent, lon, lat),
    which also fills a missing proponent and says so."""
    p = merge.union_all(blocks)
    p = p.withColumn("category", rules.category(F.col("type"), F.col("name"), F.col("description")))
    sound = in_canada(F.col("lon"), F.col("lat"))
    p = p.withColumn("lon", F.when(sound, F.col("lon"))).withColumn("lat", F.when(sound, F.col("lat")))
    if gazetteer is not None:
        names = p.where("lon is null").select(F.col("ord").alias("id"), "name", "municipality", F.col("jurisdiction").alias("admin1"))
        g = spatial.geocode(names, gazetteer).select(F.col("id").alias("ord"), F.col("lon").alias("g_lon"), F.col("lat").alias("g_lat"), F.col("place").alias("geocode_match"))
        p = p.join(g, "ord", "left").withColumn("geocode", F.when(F.col("lon").isNull() & F.col("g_lon").isNotNull(), "gazetteer"))
        p = p.withColumn("lon", F.coalesce("lon", "g_lon")).withColumn("lat", F.coalesce("lat", "g_lat")).drop("g_lon", "g_lat")
    if enrichment is not None:
        e = enrichment.select("jurisdiction", "name", F.col("proponent").alias("e_prop"), F.col("lon").alias("e_lon"), F.col("lat").alias("e_lat"))
        p = p.join(e, ["jurisdiction", "name"], "left")
        p = p.withColumn("proponent_source", F.when(F.nullif("proponent", F.lit("")).isNull() & F.col("e_prop").isNotNull(), "inventory"))
        p = p.withColumn("proponent", text.truthy(F.col("proponent"), F.col("e_prop"))).withColumn("lon", F.coalesce("lon", "e_lon")).withColumn("lat", F.coalesce("lat", "e_lat")).drop("e_prop", "e_lon", "e_lat")
    p = p.withColumn("id", text.make_id(F.col("jurisdiction"), F.col("name")))
    return dedupe.collision_suffix(p, "id", ["ord"]).drop("id").withColumnRenamed("unique_id", "id")


def depth_tier(conditions: Column, documents: Column) -> Column:
    """3 with commitments, 2 with documents, else 1."""
    return F.when(F.coalesce(conditions, F.lit(0)) > 0, 3).when(F.coalesce(documents, F.lit(0)) > 0, 2).otherwise(1)


def process_state(rows: DataFrame, frameworks: DataFrame, by_phase: DataFrame, by_status: DataFrame) -> DataFrame:
    """Adds framework, stage, macro, outcome and confidence: e from an exact phase,
    i inferred from a status, u unknown.

    rows: framework_key, phase, status.  by_phase: phase, framework, stage, macro;
    by_status: status, macro, outcome; frameworks: framework_key, framework."""
    phase = by_phase.select("phase", F.col("framework").alias("p_framework"), "stage", F.col("macro").alias("p_macro"))
    status = by_status.select("status", F.col("macro").alias("s_macro"), "outcome")
    j = rows.join(frameworks, "framework_key", "left").join(phase, "phase", "left").join(status, "status", "left")
    exact = F.col("stage").isNotNull()
    inferred = ~exact & F.col("s_macro").isNotNull()
    return (
        j.withColumn("framework", F.coalesce("p_framework", "framework"))
        .withColumn("macro", F.coalesce("p_macro", F.when(inferred, F.col("s_macro"))))
        .withColumn("outcome", F.when(inferred, F.col("outcome")))
        .withColumn("confidence", F.when(exact, "e").when(inferred, "i").otherwise("u"))
        .drop("p_framework", "p_macro", "s_macro")
    )


# Jurisdictions whose process is modelled, and phases of the later of two acts.
FEDERAL, BC = "Federal (IAAC)", "British Columbia (EAO)"
ONTARIO_REA, ONTARIO_EA = "Ontario (REA)", "Ontario (Provincial EA)"
LATER_ACT = (
    "Project Designation", "Early Engagement", "Readiness Decision", "Process Planning", "Application Development & Review",
    "Effects Assessment & Review", "Effects Assessment & Recommendation", "Recommendation",
)


def derive_process(rows: DataFrame, stages: DataFrame, by_type: DataFrame, phases: DataFrame, by_phase: DataFrame, by_status: DataFrame, bc_phases: DataFrame, rea: DataFrame) -> DataFrame:
    """Adds framework, stage, label, macro, range, sub, outcome and confidence (e exact,
    i inferred, u unknown) by the rules of each row's jurisdiction.

    rows: jurisdiction, name, type, status.  Tables of the state map:
    stages: framework, stage, label, macro, range; by_type: type (_default for all
    others), framework; phases: name, phase, ord (a federal project's phase, the first);
    by_phase: phase, framework, stage; by_status: status, macro, range, outcome;
    bc_phases: phase, stage, sub, outcome, confidence; rea: framework, stage, macro (one
    row).  Other jurisdictions have nothing but confidence u."""
    one = lambda df, key, *cols: df.select(F.col(key).alias(f"__{key}"), *(F.col(c).alias(n) for c, n in cols))
    federal, bc, is_rea = (F.col("jurisdiction") == x for x in (FEDERAL, BC, ONTARIO_REA))
    phase = phases.groupBy("name").agg(F.min_by("phase", "ord").alias("phase"))
    j = rows.join(one(phase, "name", ("phase", "__p")), federal & (F.col("name") == F.col("__name")), "left")
    j = j.join(one(by_phase, "phase", ("framework", "__pf"), ("stage", "__ps")), F.col("__p") == F.col("__phase"), "left").drop("__phase")
    j = j.join(one(by_type.where("type <> '_default'"), "type", ("framework", "__tf")), federal & (F.coalesce("type", F.lit("")) == F.col("__type")), "left")
    j = j.crossJoin(F.broadcast(by_type.where("type = '_default'").agg(F.first("framework").alias("__df"))))  # one row
    j = j.join(one(by_status, "status", ("macro", "__sm"), ("range", "__sr"), ("outcome", "__so")), federal & (F.coalesce("status", F.lit("")) == F.col("__status")), "left")
    j = j.join(one(bc_phases, "phase", ("stage", "__bs"), ("sub", "__bu"), ("outcome", "__bo"), ("confidence", "__bc")), bc & (F.coalesce("status", F.lit("")) == F.col("__phase")), "left").withColumnRenamed("__phase", "__rule")
    j = j.crossJoin(F.broadcast(rea.agg(F.first("framework").alias("__rf"), F.first("stage").alias("__rs"), F.first("macro").alias("__rm"))))
    exact = F.col("__ps").isNotNull()
    later = F.coalesce("status", F.lit("")).isin(*LATER_ACT)
    first, second = F.when(later, "bc_2018").otherwise("bc_2002"), F.when(later, "bc_2002").otherwise("bc_2018")
    j = j.withColumn("__f1", F.when(federal, F.coalesce("__pf", "__tf", "__df")).when(bc, first).when(is_rea, F.col("__rf")).when(F.col("jurisdiction") == ONTARIO_EA, "on_ea"))
    j = j.withColumn("__f2", F.when(bc, second)).withColumn("stage", F.when(federal, F.col("__ps")).when(bc, F.col("__bs")).when(is_rea, F.col("__rs")))
    # a stage that the one act lacks is looked up in the other
    at = lambda n: stages.select(F.col("framework").alias(f"__w{n}"), F.col("stage").alias(f"__s{n}"), F.col("label").alias(f"__l{n}"), F.col("macro").alias(f"__m{n}"), F.col("range").alias(f"__r{n}"))
    for n in (1, 2):
        j = j.join(at(n), (F.col(f"__f{n}") == F.col(f"__w{n}")) & (F.col("stage") == F.col(f"__s{n}")), "left")
    other = F.col("__l1").isNull() & F.col("__l2").isNotNull()
    own = lambda c: F.when(other, F.col(f"__{c}2")).otherwise(F.col(f"__{c}1"))
    rule = bc & F.col("__rule").isNotNull()
    inferred = federal & ~exact & F.col("__status").isNotNull()
    return j.select(
        *rows.columns,
        F.when(other, F.col("__f2")).otherwise(F.col("__f1")).alias("framework"),
        "stage",
        F.when(rule & F.col("stage").isNotNull(), F.coalesce(own("l"), F.col("status"))).otherwise(own("l")).alias("label"),
        F.when(inferred, F.col("__sm")).when(is_rea, F.col("__rm")).otherwise(own("m")).alias("macro"),
        F.when(inferred, F.col("__sr")).alias("range"),
        F.when(rule & F.col("stage").isNotNull(), F.col("__bu")).alias("sub"),
        F.when(inferred, F.col("__so")).when(rule, F.col("__bo")).alias("outcome"),
        F.when(federal & exact, "e").when(inferred | is_rea, "i").when(rule & (F.coalesce("__bc", F.lit("")) != "unknown"), "e").otherwise("u").alias("confidence"),
    )
