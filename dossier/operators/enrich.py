"""Lookups that add to rows what other tables know of them, row rules of the
sources, and the orders in which results are shown.

Lookups are left joins on one key: the looked-up side has one row for each key by
a partial aggregate, so no row is ever multiplied.  Keys that are null or empty
find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, web
from . import dedupe

# Hosts of the registry's own copies, bases of its archive, bounds of coordinates, noise among captured files, identity suffixes of titles.
REGISTRY = "accessenvironment.ene.gov.on.ca/instruments/"
ARCHIVE_BASE = "https://iaac-aeic.gc.ca/archives/evaluations"
LIVE_BASE = "https://iaac-aeic.gc.ca/050/evaluations/proj/"
SLUG_BASE = "https://novascotia.ca"
SLUG_PAGES = "https://novascotia.ca/nse/ea/"
KINDS = ("approval", "amendment", "revocation")
NOISE = (
    r"(?i)annual[-_ ]?report|financial|investor|quarterly|proxy|circular|"
    r"press[-_ ]?release|newsletter|brochure|career|recipe|menu|"
    r"/fr/|_fr\.|french|-fr\.pdf"
)
OWN_SUFFIX = r"\s\((doc|BAPE) \d+\)$"
FILE_LINK = r"(?i)href=[\"']?(/050/documents/[^\"'\s>]+)"
DOC_DATE = r"(?i)<meta\s+name=\"Document Date\"\s+content=\"(\d{4}-\d{2}-\d{2})"
DOC_REF = r"(?i)Document reference number:\s*</strong>\s*([^<\s][^<]*?)\s*<"

#: First letters by which matches meet titles.
GRAM = 4


def lookup(rows: DataFrame, key: Column, found: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of ``found``, null where the key isn't there.
    ``found`` has one row for each value of ``by``."""
    f = found.select(F.col(by).alias("__by"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = rows.withColumn("__key", F.nullif(key, F.lit(""))).join(f, F.col("__key") == F.col("__by"), "left")
    return j.select(*[c for c in rows.columns if c not in columns], *[F.col(f"__{c}").alias(c) for c in columns])


def document_counts(rows: DataFrame, key: Column, documents: DataFrame, by: Column, path: Column) -> DataFrame:
    """Adds doc_count and docs_path where a catalogue has the key.  documents: a
    row for each document; by: its catalogue's key; path: where that is, from the
    key as the column ``__by``."""
    n = documents.select(F.nullif(by, F.lit("")).alias("by")).where("by is not null").groupBy("by").agg(F.count("*").alias("doc_count"))
    out = lookup(rows.withColumn("__k", key), key, n, "by", ["doc_count"])
    return out.withColumn("docs_path", F.when(F.col("doc_count").isNotNull(), path)).drop("__k")


def slug_key(url: Column) -> Column:
    """The last part of a url's path without ".asp", lower case."""
    last = F.regexp_extract(F.regexp_replace(url, "/+$", ""), r"[^/]*$", 0)
    return F.lower(F.replace(last, F.lit(".asp"), F.lit("")))


def absolute(url: Column, base: str = SLUG_BASE, pages: str = SLUG_PAGES) -> Column:
    """A link of a list page: as it is, or below the site, or below the pages."""
    return F.when(url.startswith("/"), F.concat(F.lit(base), url)).when(url.startswith("http"), url).otherwise(F.concat(F.lit(pages), url))


def named_instruments(documents: DataFrame, instruments: DataFrame) -> DataFrame:
    """Documents (project, section, ord, url, title) with what their instrument's
    first page says: title, instrument_kind, date and rea_number.

    Only pages read well, of a known kind and with a date, rename a document:
    "2013-Apr-15 - Title".  A copy elsewhere of an instrument of the same kind and
    date that the registry also serves, in the same project, is marked as the
    proponent's.  pos is the place in the section: by date, undated last.
    instruments: url, status, kind, issue_date, title, rea_number; one row a url.
    """
    good = instruments.where((F.col("status") == "ok") & F.col("kind").isin(*KINDS) & (F.coalesce("issue_date", F.lit("")) != ""))
    i = good.select("url", F.col("kind").alias("instrument_kind"), F.col("issue_date").alias("date"), F.col("title").alias("__title"), "rea_number")
    d = lookup(documents, F.col("url"), i, "url", ["instrument_kind", "date", "__title", "rea_number"])
    own = F.col("url").contains(REGISTRY)
    also = F.max(own.cast("int")).over(Window.partitionBy("project", "instrument_kind", "date")) == 1
    name = F.concat_ws(" - ", F.coalesce(text.pretty_date(F.col("date")), F.col("date")), "__title")
    name = F.concat(name, F.when(~own & also, " (proponent copy)").otherwise(""))
    d = d.withColumn("title", F.when(F.col("instrument_kind").isNotNull(), name).otherwise(F.col("title"))).drop("__title")
    w = Window.partitionBy("project", "section").orderBy(F.asc_nulls_last("date"), "ord")
    return d.withColumn("pos", F.row_number().over(w))


def by_row_html(rows: DataFrame, html: str, pattern: str, places: DataFrame, by: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Adds key (the pattern's group in a row's HTML), lon and lat of ``places``
    (by, lon, lat), null outside the bounds (west, south, east, north)."""
    keyed = rows.withColumn("key", text.group(F.col(html), pattern))
    out = lookup(keyed, F.col("key"), places, by, ["lon", "lat"])
    west, south, east, north = bounds
    fine = (F.col("lon") > west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") < north)
    return out.withColumn("__fine", fine).withColumn("lon", F.when(F.col("__fine"), F.col("lon"))).withColumn("lat", F.when(F.col("__fine"), F.col("lat"))).drop("__fine")


def citations(subjects: DataFrame) -> DataFrame:
    """map_id, year (the first report's), regime (of that report) and citations by
    year; subjects: map_id, shorthand, report_year, ea_regime."""
    c = F.array_sort(F.collect_list(F.struct("report_year", "shorthand", "ea_regime")))
    g = subjects.where(F.nullif("map_id", F.lit("")).isNotNull()).groupBy("map_id").agg(c.alias("citations"))
    return g.select("map_id", F.col("citations")[0]["report_year"].alias("year"), F.col("citations")[0]["ea_regime"].alias("regime"), F.transform("citations", lambda x: x["shorthand"]).alias("citations"))


def landmarks(projects: DataFrame, subjects: DataFrame) -> DataFrame:
    """Projects (id) with year, regime and citations of those that are cited."""
    return lookup(projects, F.col("id"), citations(subjects), "map_id", ["year", "regime", "citations"])


def archived_copies(documents: DataFrame, manifest: DataFrame, suffix: str = OWN_SUFFIX) -> DataFrame:
    """Documents (url, title, date, archive_url) with the manifest's archive_url
    where it has one, and its date where they have none; a title whose document
    gets a date loses the identity suffix that stood for it.  One row a url."""
    m = manifest.select("url", F.col("archive_url").alias("__au"), F.col("doc_date").alias("__dd"))
    d = lookup(documents, F.col("url"), m, "url", ["__au", "__dd"])
    dated = F.nullif("__dd", F.lit("")).isNotNull() & F.nullif("date", F.lit("")).isNull()
    d = d.withColumn("title", F.when(dated, F.regexp_replace(F.coalesce("title", F.lit("")), suffix, "")).otherwise(F.col("title")))
    d = d.withColumn("date", F.when(dated, F.col("__dd")).otherwise(F.col("date")))
    return d.withColumn("archive_url", text.truthy(F.col("__au"), F.col("archive_url"))).drop("__au", "__dd").select(*documents.columns)


def archetypes(documents: DataFrame, projects: DataFrame, default: Column, url_col: str = "registry_url") -> DataFrame:
    """Documents (project_id, project) with the category of the project whose url
    ends with their id, else whose name starts alike (40 characters), else the
    default.  projects: ord, registry_url, name, category; the first of equals."""
    p = projects.select("ord", F.col("category"), F.regexp_extract(url_col, r"[^/]*$", 0).alias("pid"), F.lower(F.substring("name", 1, 40)).alias("start"))
    pick = lambda key, name: p.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min_by("category", "ord").alias(name))
    d = lookup(documents, F.col("project_id"), pick("pid", "by_id"), "pid", ["by_id"])
    d = lookup(d, F.lower(F.substring("project", 1, 40)), pick("start", "by_name"), "start", ["by_name"])
    return d.withColumn("archetype", F.coalesce("by_id", "by_name", default)).drop("by_id", "by_name")


def variants_of(names: DataFrame, variants: DataFrame, least: int = 6) -> DataFrame:
    """name_id and the target of each company name: the target one of whose variants
    it is, normalised, else the first one (by ord) a variant of which, of ``least``
    letters or more, it contains; names without any stay, with a null target.

    names: name_id, name; variants: target, variant, ord.  Containment is found by
    the variant's first ``least`` letters: names are cut into all runs of as many, so
    the join is on equal keys, and checked afterwards.
    """
    n = names.select("name_id", text.norm_company(F.col("name")).alias("__n"))
    v = variants.select("target", F.col("ord").alias("__o"), text.norm_company(F.col("variant")).alias("__v")).where("__v <> ''")
    v = v.groupBy("__v").agg(F.min_by("target", "__o").alias("target"), F.min("__o").alias("__o"))
    exact = n.join(v, F.col("__n") == F.col("__v")).select("name_id", "target", F.lit(0).alias("tier"), "__o")
    size = F.greatest(F.length("__n") - (least - 1), F.lit(0))
    grams = F.when(size > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr("__n", i, F.lit(least))))).otherwise(F.array())
    inside = n.select("name_id", "__n", F.explode(grams).alias("__g")).join(v.where(F.length("__v") >= least).withColumn("__g", F.substring("__v", 1, least)), "__g")
    inside = inside.where(F.contains("__n", "__v")).select("name_id", "target", F.lit(1).alias("tier"), "__o")
    best = exact.unionAll(inside).groupBy("name_id").agg(F.min_by("target", F.struct("tier", "__o")).alias("target"))
    return names.select("name_id").join(best, "name_id", "left")


def crosswalk(seed: DataFrame, mapping: DataFrame, key: str, known: DataFrame, ident: str) -> DataFrame:
    """Seed rows with their mapping.  A seed key without a mapping, or a mapping to
    an id that ``known`` lacks, ends the job: both are counted first."""
    strangers = seed.join(mapping, key, "left_anti").select(F.col(key).alias("x"))
    lost = mapping.where(F.col(ident).isNotNull()).join(known.select(ident), ident, "left_anti").select(F.col(ident).cast("string").alias("x"))
    wrong = strangers.withColumn("what", F.lit("unmapped")).unionByName(lost.withColumn("what", F.lit("unknown id"))).agg(F.count("*").alias("n"), F.min_by("x", "x").alias("x"), F.min("what").alias("what")).first()
    if wrong["n"]:
        raise ValueError(f"{wrong['n']} rows of the crosswalk fail, such as {wrong['x']!r} ({wrong['what']})")
    return seed.join(mapping, key)


def layer_titles(layers: DataFrame, entries: DataFrame) -> DataFrame:
    """For each layer (label, match) the first entry (ord, title, link) with a link
    whose title contains the match, inside a word or across words.  Titles are cut
    into all runs of one to ``GRAM`` letters and met on the match's first letters; an
    empty match is in every title."""
    title = F.lower(F.coalesce("title", F.lit("")))
    # the first entry of a title stands for it; of entries without an order, any
    first = entries.where(F.nullif("link", F.lit("")).isNotNull()).groupBy(title.alias("__t")).agg(F.min_by(F.struct("ord", "title", "link"), "ord").alias("f"))
    t = F.col("__t")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *(runs(n) for n in range(1, GRAM + 1))))
    e = first.select("__t", "f.*", F.explode(grams).alias("__w"))
    m = layers.select("label", "match", F.lower(F.substring("match", 1, GRAM)).alias("__w"))
    # Spark takes the runs for as small as the titles and would broadcast them
    hit = m.join(e.hint("merge"), "__w").where(F.contains("__t", F.lower("match")))
    return hit.groupBy("label").agg(F.min_by(F.struct("title", "link"), "ord").alias("b")).select("label", "b.title", "b.link")


def catalogue_of_archive(rows: DataFrame) -> DataFrame:
    """Archived documents by project: project_id, url, title, category, of rows with
    a project and a path; the first row of a url in its project, titles of one line."""
    r = rows.where((F.col("document_type") == "archive-document") & (F.coalesce("project_id", F.lit("")) != "") & (F.coalesce("relative_path", F.lit("")) != ""))
    title = text.collapse(text.truthy(F.col("title"), F.col("file_name"), F.lit("Document")))
    r = r.select("ord", "project_id", title.alias("title"), text.truthy(F.col("category"), F.lit("Archived")).alias("category"), F.concat(F.lit(ARCHIVE_BASE), F.translate("relative_path", "\\", "/")).alias("url"))
    return dedupe.keep_first(r, ["project_id", "url"], ["ord"]).drop("ord")


def registry_rows(rows: DataFrame) -> DataFrame:
    """Rows of the federal list that are projects: of two document types, with an id,
    archived ones with a path; the first of an id.  Adds registry_url and archived."""
    archived = F.col("document_type") == "archive-project"
    fine = F.col("document_type").isin("project", "archive-project") & (F.coalesce("project_id", F.lit("")) != "") & (~archived | (F.coalesce("relative_path", F.lit("")) != ""))
    r = dedupe.keep_first(rows.where(fine), ["project_id"], ["ord"])
    link = F.when(archived, F.concat(F.lit(ARCHIVE_BASE), F.translate("relative_path", "\\", "/"))).otherwise(F.concat(F.lit(LIVE_BASE), "project_id"))
    return r.withColumn("registry_url", link).withColumn("archived", F.when(archived, True))


def name_or_value(json: Column, field: str) -> Column:
    """A field that is either text or an object with a name."""
    inner = F.get_json_object(json, f"$.{field}.name")
    return F.coalesce(inner, F.when(~F.get_json_object(json, f"$.{field}").startswith("{"), F.get_json_object(json, f"$.{field}")))


def point(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Numbers of a point; both null where one is missing or no number."""
    x, y = lon.try_cast("double"), lat.try_cast("double")
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def with_points(rows: DataFrame, lon: str, lat: str, drop: bool) -> DataFrame:
    """Rows with numeric lon and lat; those without go, or keep null ones."""
    x, y = point(F.col(lon), F.col(lat))
    out = rows.withColumn("__x", x).withColumn("__y", y).drop(lon, lat).withColumnsRenamed({"__x": lon, "__y": lat})
    return out.where(F.col(lon).isNotNull()) if drop else out


def kept_labels(labels: DataFrame) -> DataFrame:
    """Labels that the classifier didn't discard (discard null: kept)."""
    return labels.where(~F.coalesce("discard", F.lit(False)))


def noisy(url: Column) -> Column:
    """Whether a captured file is obviously no part of an assessment's record."""
    return F.coalesce(url.rlike(NOISE), F.lit(False))


def first_good(status: Column, first: Column, second: Column) -> Column:
    """The first address, or, where it failed, the second if there is one."""
    return F.when(F.coalesce(status.between(200, 299), F.lit(False)), first).otherwise(text.truthy(second, first))


def between(rows: DataFrame, date: str, since: str | None = None, until: str | None = None, active: str | None = None, show_active: bool = True, show_inactive: bool = True) -> DataFrame:
    """Rows in a range of dates, both ends included, by the two toggles of state."""
    out = rows
    if since is not None:
        out = out.where(F.col(date) >= since)
    if until is not None:
        out = out.where(F.col(date) <= until)
    if active is not None:
        out = out.where((F.col(active) & F.lit(show_active)) | (~F.col(active) & F.lit(show_inactive)))
    return out


def federal_meta(html: Column, url: Column) -> dict[str, Column]:
    """Date, reference number and file address of a registry's document page; a page
    without a file is a notice of its own."""
    file = text.group(html, FILE_LINK)
    root = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    ref = F.substring(F.trim(text.group(html, DOC_REF)), 1, 40)
    return {"doc_date": text.group(html, DOC_DATE), "doc_ref": ref, "file_url": F.concat(root, file)}


def base_id(ident: Column) -> Column:
    """An id without the letter that tells split parts apart."""
    return F.regexp_replace(ident, r"-\p{L}$", "")


def seen_urls(documents: DataFrame, order: list, url: str = "url") -> DataFrame:
    """The first document of each web address over all catalogues."""
    return dedupe.keep_first(documents.where(F.col(url).rlike("^https?://")), [url], order)


def inventories(live: DataFrame, captured: DataFrame) -> DataFrame:
    """Live and captured documents under one another, with their source; one for
    each normalised address of a key, live ones first, then by url."""
    both = live.withColumn("source", F.lit("live")).unionByName(captured.withColumn("source", F.lit("wayback")), allowMissingColumns=True)
    return dedupe.keep_first(both.withColumn("__u", text.norm_url(F.col("url"))), ["key", "__u"], live_first()).drop("__u")


# ---- orders

def gaps_first(verdict: str = "verdict", value: str = "value") -> list[Column]:
    """Gaps, then weak, then matched; by falling value, what is no number as 0."""
    rank = F.when(F.col(verdict) == "gap", 0).when(F.col(verdict) == "weak", 1).otherwise(2)
    return [rank.asc(), F.coalesce(F.col(value).try_cast("double"), F.lit(0.0)).desc()]


def dated_first(date: str = "date") -> list[Column]:
    """By date, undated last; an empty date is one, and comes first."""
    return [F.asc_nulls_last(date)]


def latest_first(date: str = "date") -> list[Column]:
    """By falling date, undated and empty ones last."""
    return [F.coalesce(F.col(date), F.lit("")).desc()]


def number_desc(column: str, pattern: str) -> list[Column]:
    """By the falling number that the pattern finds."""
    return [F.regexp_extract(column, pattern, 1).try_cast("long").desc_nulls_last()]


def live_first(source: str = "source", url: str = "url") -> list[Column]:
    return [(F.col(source) != "live").asc(), F.asc(url)]


def broken_first(verdict: str = "verdict", source: str = "source", fine: tuple[str, ...] = ("ok", "js_app", "index_verified", "skipped")) -> list[Column]:
    return [F.col(verdict).isin(*fine).asc(), F.asc(source)]
