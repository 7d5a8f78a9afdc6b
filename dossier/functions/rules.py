"""Ordered rule tables compiled to one CASE expression, evaluated in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Keywords = Sequence[tuple[str, Sequence[str]]]

# Project categories and their keywords, in order of precedence.
CATEGORY_RULES: Keywords = (
    ("wind", ("wind", "éolien", "eolien")),
    ("solar", ("solar", "solaire")),
    ("biogas", ("biogas", "anaerobic", "biomass", "bioenergy", "biométhane", "biomethane", "biomasse")),
    ("hydro", ("hydro", "dam", "water power", "waterpower", "barrage", "digue", "rivière", "riviere")),
    ("mining", ("mine", "mining", "quarry", "aggregate", "coal", "metal", "minier", "minière", "miniere", "carrière", "carriere", "banc d'emprunt")),
    ("oil_gas", ("oil", "gas", "lng", "pipeline", "petroleum", "refinery", "hydrocarbure", "oléoduc", "oleoduc", "gazoduc", "pétrolière", "petroliere", "gaz naturel")),
    ("nuclear", ("nuclear", "uranium", "nucléaire", "nucleaire")),
    ("energy_other", ("energy", "electric", "transmission", "power", "énergie", "energie", "centrale")),
    ("transport", ("highway", "road", "rail", "bridge", "port", "terminal", "airport", "ferry", "transport", "marine", "routière", "routiere", "ferroviaire", "aéroport", "aeroport", "quai")),
    ("water", ("water", "wastewater", "sewage", "flood", "irrigation", "reservoir", "dredg", "milieux humides", "hydrique", "réservoir", "dragage", "eaux")),
    ("industrial", ("industrial", "plant", "facility", "manufactur", "pulp", "mill", "smelter", "industrie", "métallurgique", "metallurgique", "chimique", "usine")),
    ("waste", ("waste", "landfill", "hazardous", "matières résiduelles", "matieres residuelles", "déchet", "dechet", "sols contaminés", "sols contamines")),
    ("agriculture", ("agricult", "production animale", "farm", "élevage", "elevage")),
    ("tourism", ("tourist", "resort", "récréotouristique", "recreotouristique")),
)
# Short words that only count as whole words.
WHOLE_WORDS = ("dam", "mill", "port", "oil", "gas", "rail", "road", "metal", "coal", "mine", "plant", "power", "water", "waste")

# Disciplines by keyword frequency.
DISCIPLINE_RULES: Keywords = (
    ("fish_fish_habitat", ("fish", "riparian", "instream", "spawn")),
    ("wetlands", ("wetland", "bog", "fen", "marsh")),
    ("surface_water", ("surface water", "water quality", "sediment", "erosion", "turbidity", "discharge", "effluent", "runoff")),
    ("groundwater", ("groundwater", "aquifer", "well")),
    ("wildlife_birds", ("wildlife", "bird", "nest", "bat", "ungulate", "bear", "moose", "caribou", "raptor", "migratory")),
    ("species_at_risk", ("species at risk", "endangered", "threatened", "sara")),
    ("vegetation_ecosystems", ("vegetation", "plant", "ecosystem", "old growth", "invasive", "revegetat", "reclam")),
    ("air_quality", ("air quality", "dust", "emission", "particulate")),
    ("noise_vibration", ("noise", "vibration", "sound")),
    ("ghg_climate", ("greenhouse gas", "ghg", "climate", "carbon")),
    ("indigenous_rights_tluse", ("indigenous", "first nation", "aboriginal", "traditional use", "treaty", "nation")),
    ("archaeology_heritage", ("archaeolog", "heritage", "cultural site")),
    ("human_health", ("human health", "country food", "drinking water")),
    ("socio_economic", ("employment", "training", "housing", "community", "economic", "workforce")),
    ("waste_hazmat", ("waste", "hazardous", "spill", "fuel", "chemical", "tailings")),
    ("soils_terrain", ("soil", "terrain", "slope", "geotechnical", "acid rock", "metal leaching")),
    ("closure_postclosure", ("closure", "decommission", "post-closure", "reclamation security", "bond")),
    ("accidents_malfunctions", ("accident", "malfunction", "emergency", "contingency")),
)
# Measure types by keyword frequency.
MEASURE_RULES: Keywords = (
    ("management_plan", ("management plan", "plan must", "develop a plan", "monitoring plan", "protection plan", "mitigation plan")),
    ("monitoring_followup", ("monitor", "sampling", "survey", "report annually", "follow-up", "audit")),
    ("avoidance_timing", ("timing window", "least risk", "no construction during", "avoid", "setback", "buffer")),
    ("engagement_commitment", ("consult", "engage", "notify", "communicate")),
    ("financial_assurance", ("security", "bond", "financial assurance")),
    ("compensation_offsetting", ("offset", "compensat", "habitat replacement")),
    ("minimization_design", ("design", "install", "use of", "equip")),
)
# Section titles to disciplines, by the first substring.
SECTION_RULES = (
    ("fish", "fish_fish_habitat"), ("migratory bird", "wildlife_birds"), ("bird", "wildlife_birds"), ("wildlife", "wildlife_birds"),
    ("caribou", "species_at_risk"), ("species at risk", "species_at_risk"), ("wetland", "wetlands"), ("vegetation", "vegetation_ecosystems"),
    ("air quality", "air_quality"), ("greenhouse gas", "climate_ghg"), ("noise", "noise_vibration"), ("light", "light"),
    ("groundwater", "groundwater"), ("surface water", "surface_water"), ("water quality", "surface_water"), ("soil", "soils_terrain"),
    ("human health", "human_health"), ("health", "human_health"), ("socio-economic", "socio_economic"), ("current use of lands", "indigenous_rights_tluse"),
    ("indigenous", "indigenous_rights_tluse"), ("aboriginal", "indigenous_rights_tluse"), ("first nation", "indigenous_rights_tluse"), ("heritage", "archaeology_heritage"),
    ("archaeolog", "archaeology_heritage"), ("structure, site or thing", "archaeology_heritage"), ("accident", "accidents_malfunctions"), ("malfunction", "accidents_malfunctions"),
    ("waste", "waste_hazmat"), ("effluent", "surface_water"), ("decommissioning", "closure_postclosure"), ("reclamation", "closure_postclosure"),
    ("follow-up", "other"), ("general condition", "other"), ("administrative", "other"), ("documentation", "other"), ("implementation schedule", "other"),
)
# Document types by the first pattern in title and url.
DOC_TYPES = (
    (r"draft.{0,20}environmental\s*study\s*report|draft.{0,10}\bESR\b", "ESR_draft"),
    (r"final.{0,20}environmental\s*study\s*report|final.{0,10}\bESR\b", "ESR_final"),
    (r"environmental\s*study\s*report|\bESR\b", "ESR"),
    (r"environmental\s*(impact|assessment)\s*(statement|report)|\bEIS\b|\bEA\s*report", "EA_report"),
    (r"terms\s*of\s*reference|\bToR\b", "terms_of_reference"),
    (r"notice\s*of\s*commencement", "notice_of_commencement"),
    (r"notice\s*of\s*completion|statement\s*of\s*completion", "notice_of_completion"),
    (r"screening", "screening"),
    (r"open\s*house|public\s*(information\s*centre|meeting|consultation)|\bPIC\b", "open_house"),
    (r"monitoring|follow-?up", "monitoring"),
    (r"closure|reclamation|decommission", "closure"),
    (r"technical\s*(report|memo)|baseline|appendix|appendices", "technical"),
    (r"\bmap\b|figure|route", "map"),
    (r"newsletter|bulletin|fact\s*sheet|update", "newsletter"),
    (r"presentation|slides?", "presentation"),
    (r"permit|approval|licen[cs]e|leave\s*to\s*construct", "permit_approval"),
    (r"indigenous|first\s*nation|m[ée]tis|engagement|consultation", "engagement"),
)
# Vocabularies of conditions.
DISCIPLINES = (
    "surface_water", "groundwater", "fish_fish_habitat", "wetlands", "vegetation_ecosystems", "wildlife_birds", "species_at_risk", "air_quality",
    "noise_vibration", "light", "soils_terrain", "waste_hazmat", "accidents_malfunctions", "human_health", "socio_economic", "indigenous_rights_tluse",
    "archaeology_heritage", "visual_landscape", "climate_ghg", "cumulative_effects", "closure_postclosure", "other",
)
MEASURE_TYPES = ("avoidance", "minimization", "mitigation", "compensation_offset", "management_plan", "monitoring_followup", "financial_assurance", "engagement", "other")
TIMINGS = ("pre_construction", "construction", "operation", "closure", "post_closure", "all_phases")
# Disciplines that a spatial constraint, every project, or an archetype fires.
TRIGGERS = {
    "wetland": ("wetlands", "surface_water"),
    "watercourse": ("fish_fish_habitat", "surface_water"),
    "waterbody": ("fish_fish_habitat", "surface_water"),
    "species_at_risk": ("species_at_risk", "wildlife_birds", "vegetation_ecosystems"),
    "reserve": ("indigenous_rights_tluse",),
    "ansi": ("vegetation_ecosystems", "species_at_risk"),
    "abandoned_mine": ("soils_terrain", "waste_hazmat"),
}
ALWAYS = ("indigenous_rights_tluse", "accidents_malfunctions", "archaeology_heritage")
BY_ARCHETYPE = {
    "mining": ("closure_postclosure", "waste_hazmat", "groundwater", "surface_water"),
    "oil_gas": ("accidents_malfunctions", "climate_ghg", "waste_hazmat"),
    "waste": ("groundwater", "waste_hazmat", "air_quality"),
    "hydro": ("fish_fish_habitat", "surface_water"),
    "wind": ("wildlife_birds", "noise_vibration", "closure_postclosure"),
    "solar": ("vegetation_ecosystems", "noise_vibration", "closure_postclosure"),
    "biogas": ("air_quality", "waste_hazmat", "surface_water"),
    "transport": ("noise_vibration", "surface_water", "socio_economic"),
    "nuclear": ("human_health", "waste_hazmat", "accidents_malfunctions"),
    "industrial": ("air_quality", "surface_water"),
}


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = "other", ignore_case: bool = True) -> Column:
    """The label of the first (pattern, label) that occurs; else ``default``."""
    out = None
    for pattern, label in rules:
        hit = text.rlike(("(?iu)" if ignore_case else "") + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def word_rules(rules: Keywords, whole: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Keywords that match at the start of a word, or, if in ``whole``, as a whole word."""
    return [("|".join(r"\b" + re.escape(k) + (r"\b" if k in whole else "") for k in keys), label) for label, keys in rules]


def first_substring(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first (substring, label) contained, whatever its case."""
    out, low = None, F.lower(text)
    for key, label in rules:
        out = F.when(low.contains(key), label) if out is None else out.when(low.contains(key), label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


# Archetypes by what a name contains, in order of precedence; also inside words.
ARCHETYPES = (
    ("mining", ("mine", "mining", "nickel", "gold", "copper", "iron", "coal", "quarry", "potash", "uranium", "lithium", "diamond")),
    ("oil_gas", ("lng", "gas", "oil", "pipeline", "petroleum", "well", "offshore", "drilling")),
    ("transport", ("highway", "bridge", "terminal", "port", "rail", "marine", "airport", "wharf")),
    ("hydro", ("hydro", "dam", "generating station", "reservoir")),
    ("wind", ("wind",)),
    ("nuclear", ("nuclear", "reactor")),
    ("industrial", ("plant", "facility", "smelter", "refinery")),
)


def archetype_of(name: Column) -> Column:
    """A name's archetype by the first keyword that it contains anywhere."""
    return first_substring(F.coalesce(name, F.lit("")), [(k, label) for label, keys in ARCHETYPES for k in keys], "other")


def by_tier(text: Column, tiers: Sequence[tuple[str, int]], rest: int) -> Column:
    """The tier of the first pattern that occurs, else the last."""
    return first_match(text, [(p, str(t)) for p, t in tiers], str(rest), ignore_case=False).cast("int")


def category(kind: Column, name: Column | None = None, description: Column | None = None) -> Column:
    """A project's category from its type, else from its name and description."""
    rules = word_rules(CATEGORY_RULES, WHOLE_WORDS)
    own = first_match(F.lower(F.coalesce(kind, F.lit(""))), rules, ignore_case=False)
    if name is None:
        return own
    more = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description if description is not None else F.lit(""), F.lit("")))
    return F.when(own != "other", own).otherwise(first_match(F.lower(more), rules, ignore_case=False))


def occurrences(text: Column, key: str) -> Column:
    """How often ``key`` occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(key), F.lit("")))) / len(key)).cast("int")


def best_keywords(text: Column, rules: Keywords, default: str) -> Column:
    """The first label with the highest sum of keyword counts; none counted: default."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scored = F.array(*[F.struct(sum((occurrences(low, k) for k in keys), F.lit(0)).alias("score"), F.lit(-i).alias("at"), F.lit(label).alias("label")) for i, (label, keys) in enumerate(rules)])
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["label"]).otherwise(F.lit(default))


def fired(archetype: str, constraints: Sequence[str] = (), full: bool = False) -> list[str]:
    """Sorted disciplines that an archetype and its constraints fire; ``full``: all but other."""
    if full:
        return sorted(d for d in DISCIPLINES if d != "other")
    out = set(ALWAYS) | set(BY_ARCHETYPE.get(archetype, ()))
    for c in constraints:
        out |= set(TRIGGERS.get(c, ()))
    return sorted(out)
