"""Conditions out of document texts: regions, marks, bodies and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where numbered segments begin, marks of conditions, names of plans, headings,
# definitions, and where the conditions of a document end.
_SEGMENT = r"\n\s*(?=(?:\d{1,2}(?:\.\d{1,2})?[.)]\s+[A-Z])|(?:Condition\s+\d))"
_MARK = r"(?<=[\s;.])(\d{1,2}\.\d{1,2})\s+(?=[A-Z“\"])"
_PLAN = r"\b([A-Z][A-Za-z]+(?:\s+[A-Za-z&-]+){0,5}\s+(?:Management|Monitoring|Protection|Mitigation|Response|Contingency)\s+Plan)\b"

_HEADING = r"(?:^|[\s.;])(\d{1,2})\.?\s+([A-Z][A-Za-z][^0-9.;]{2,90})"
_DEFINITION = r"^[“\"]?[A-Za-z][^.]{0,80}\bmeans\b"
_END = r"\b(?:Issuance|Original signed|Signed at|SIGNATURE)\b"


def segments(docs: DataFrame, least: int = 120, most: int = 6000, at_least: int = 3) -> DataFrame:
    """Numbered segments (doc_id, pos, segment) of sufficient length, of documents
    that have enough of them."""
    s = docs.select("doc_id", F.posexplode(F.split("text", _SEGMENT)).alias("pos", "segment")).withColumn("segment", F.trim("segment"))
    s = s.where((F.length("segment") > least) & (F.length("segment") < most))
    return s.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("n") >= at_least).drop("n")


def region(text: Column) -> Column:
    """The part of a document that holds conditions: from the word Conditions, or
    the start, up to the first mark of its signatures, or the end."""
    return F.regexp_extract(text, rf"(?s)(?:\bConditions\b|^(?!.*\bConditions\b)).*?(?={_END}|\z)", 0)


def marked_conditions(docs: DataFrame) -> DataFrame:
    """doc_id, i, condition_no, section_title, body of numbered conditions.

    A region is a row of gaps with a mark between any two; the gap behind a mark is
    its condition's body, the one ahead of it may end with the section's heading.
    A section has the heading that stands ahead of its latest ".1"; until there is
    one, the first that stands ahead of any of its marks.  Bodies under 40
    characters and definitions are no conditions, but their headings count."""
    gaps, marks = F.split("r", _MARK), F.regexp_extract_all("r", F.lit(_MARK), 1)
    rows = docs.select("doc_id", region(F.col("text")).alias("r")).select("doc_id", gaps.alias("gaps"), F.posexplode(marks).alias("i", "condition_no"))
    rows = rows.select("doc_id", "i", "condition_no", F.split_part("condition_no", F.lit("."), F.lit(1)).alias("section"), F.element_at("gaps", F.col("i") + 1).alias("ahead"), F.trim(F.element_at("gaps", F.col("i") + 2)).alias("body"))
    numbered = F.arrays_zip(F.regexp_extract_all("ahead", F.lit(_HEADING), 1).alias("section"), F.regexp_extract_all("ahead", F.lit(_HEADING), 2).alias("title"))
    own = F.filter(numbered, lambda h: h["section"] == F.col("section"))
    rows = rows.withColumn("title", F.trim(F.try_element_at(own, F.lit(-1))["title"])).drop("ahead")
    section = Window.partitionBy("doc_id", "section")
    earliest = F.min(F.when(F.col("title").isNotNull(), F.col("i"))).over(section)
    names = (F.col("i") == earliest) | F.col("condition_no").endswith(".1")
    so_far = section.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("named", F.when(names, F.col("title"))).withColumn("section_title", F.last("named", ignorenulls=True).over(so_far))
    defines = (F.col("section") == "1") & (F.col("body").rlike(_DEFINITION) | ~F.substring("body", 1, 600).contains("shall"))
    return rows.where((F.length("body") >= 40) & ~defines).select("doc_id", "i", "condition_no", "section_title", "body")


def plan_name(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring(text, 1, 1200), _PLAN, 1), F.lit(""))


def next_boundary(marks: DataFrame, key: str, start: str, end: Column) -> DataFrame:
    """Each mark's end: the next mark's start, or the end given."""
    w = Window.partitionBy(key).orderBy(start)
    return marks.withColumn("stop", F.coalesce(F.lead(start).over(w), end)).withColumn("gap", F.col(start) - F.lag(start).over(w))


def carry_heading(marks: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """The last heading seen, at every row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("heading", F.last(heading, ignorenulls=True).over(w))


def sequence_ids(rows: DataFrame, prefix: Column, key: str, order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("seq_id", F.format_string("%s-%03d", prefix, n))
