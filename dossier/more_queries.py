"""Registered queries of lookups, row rules, orders, segments and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules, text, web
from .operators import dedupe, enrich, match, merge, numbering, predict, quality, segment, spatial
from .plans.tables import lonlat, table
from .queries import _IDF, _sides, query
from .streaming import hosts

# ---- lookups


@query("SELECT c_custkey, n AS doc_count, CASE WHEN n IS NOT NULL THEN 'data/docs/bc/' || c_custkey || '.json' END AS docs_path FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey")
def doc_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").where("o_orderstatus = 'F'")
    path = F.concat(F.lit("data/docs/bc/"), "__k", F.lit(".json"))
    return enrich.document_counts(table(spark, d, "customer").select("c_custkey"), F.col("c_custkey").cast("string"), docs, F.col("o_custkey").cast("string"), path)


@query(r"""WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/nse/ea/' || s WHEN 1 THEN 'https://www.x.ca/' || s ELSE s END AS u FROM (SELECT page_id, 'Wind-' || (page_id % 40) || CASE page_id % 2 WHEN 0 THEN '.asp' ELSE '/' END AS s FROM pages)),
a AS (SELECT page_id, CASE WHEN starts_with(u, '/') THEN 'https://novascotia.ca' || u WHEN starts_with(u, 'http') THEN u ELSE 'https://novascotia.ca/nse/ea/' || u END AS url FROM r),
k AS (SELECT *, lower(replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '.asp', '')) AS slug FROM a), c AS (SELECT 'wind-' || (p_size % 50) AS slug, count(*) AS n FROM part GROUP BY 1)
SELECT page_id, url, n AS doc_count, CASE WHEN n IS NOT NULL THEN 'data/docs/ns/' || slug || '.json' END AS docs_path FROM k LEFT JOIN c USING (slug)""")
def slug_join(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    slug = F.concat(F.lit("Wind-"), k % 40, F.when(k % 2 == 0, ".asp").otherwise("/"))
    link = F.when(k % 3 == 0, F.concat(F.lit("/nse/ea/"), slug)).when(k % 3 == 1, F.concat(F.lit("https://www.x.ca/"), slug)).otherwise(slug)
    rows = table(spark, d, "pages").select("page_id", enrich.absolute(link).alias("url"))
    docs = table(spark, d, "part").select(F.concat(F.lit("https://y/WIND-"), F.col("p_size") % 50, F.lit(".asp/")).alias("u"))
    return enrich.document_counts(rows, enrich.slug_key(F.col("url")), docs, enrich.slug_key(F.col("u")), F.concat(F.lit("data/docs/ns/"), "__k", F.lit(".json")))


_DOCS = """SELECT o_custkey AS project, o_orderpriority AS section, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'https://www.accessenvironment.ene.gov.on.ca/instruments/' ELSE 'https://p.example/' END || o_orderkey AS url, 'Download' AS title,
 CASE o_orderstatus WHEN 'P' THEN 'fail' ELSE 'ok' END AS status, ['approval','amendment','revocation','other'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y') || '-04-0' || (o_orderkey % 2 + 1) END AS issue_date FROM orders"""


@query(f"""WITH d AS ({_DOCS}), g AS (SELECT *, status = 'ok' AND kind <> 'other' AND issue_date IS NOT NULL AS good, contains(url, 'accessenvironment') AS own FROM d),
n AS (SELECT *, CASE WHEN good THEN kind END AS instrument_kind, CASE WHEN good THEN issue_date END AS date FROM g), c AS (SELECT *, max(CASE WHEN own THEN 1 ELSE 0 END) OVER (PARTITION BY project, instrument_kind, date) AS has FROM n)
SELECT ord, CASE WHEN good THEN left(date, 5) || 'Apr' || substr(date, 8) || ' - Renewable Energy Approval' || CASE WHEN NOT own AND has = 1 THEN ' (proponent copy)' ELSE '' END ELSE title END AS title,
 instrument_kind, date, CASE WHEN good THEN 'R' || ord END AS rea_number, CAST(row_number() OVER (PARTITION BY project, section ORDER BY date NULLS LAST, ord) AS INTEGER) AS pos FROM c""")
def named_instruments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("url", F.concat(F.when(k % 3 == 0, "https://www.accessenvironment.ene.gov.on.ca/instruments/").otherwise("https://p.example/"), k))
    docs = o.select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("section"), k.alias("ord"), "url", F.lit("Download").alias("title"))
    kind = F.element_at(F.array(*map(F.lit, ("approval", "amendment", "revocation", "other"))), (k % 4 + 1).cast("int"))
    date = F.when(k % 7 != 0, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-04-0"), k % 2 + 1))
    found = o.select("url", F.when(F.col("o_orderstatus") == "P", "fail").otherwise("ok").alias("status"), kind.alias("kind"), date.alias("issue_date"), F.lit("Renewable Energy Approval").alias("title"), F.concat(F.lit("R"), k).alias("rea_number"))
    return enrich.named_instruments(docs, found).select("ord", "title", "instrument_kind", "date", "rea_number", "pos")


@query("""WITH c AS (SELECT c_custkey AS k, -140.0 + (c_custkey * 7919) % 8700 / 100.0 AS lon, 42.0 + (c_custkey * 104729) % 4100 / 100.0 AS lat FROM customer)
SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey * 3 AS VARCHAR) END AS key, CASE WHEN lon > -85 AND lon < -50 AND lat > 40 AND lat < 65 THEN lon END AS lon, CASE WHEN lon > -85 AND lon < -50 AND lat > 40 AND lat < 65 THEN lat END AS lat
FROM supplier LEFT JOIN c ON s_suppkey % 4 <> 0 AND k = s_suppkey * 3""")
def row_coordinates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit('<a href="fiche.asp?'), F.when(k % 4 != 0, F.concat(F.lit("no_dossier="), k * 3)).otherwise(""), F.lit('&x=1">')).alias("html"))
    lon, lat = lonlat(F.col("c_custkey"))
    places = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("by"), lon.alias("lon"), lat.alias("lat"))
    return enrich.by_row_html(rows, "html", 'no_dossier=([^"&]+)', places, "by", (-85, 40, -50, 65)).drop("html")


@query("""WITH s AS (SELECT 'c' || o_custkey AS map_id, 's' || o_orderkey AS sh, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus AS r FROM orders WHERE o_orderpriority = '1-URGENT'),
g AS (SELECT map_id, min(y) AS year, arg_min(r, (y, sh, r)) AS regime, array_to_string(list_transform(list_sort(list((y, sh, r))), lambda x: x[2]), '|') AS citations FROM s GROUP BY 1)
SELECT 'c' || c_custkey AS id, year, regime, citations FROM customer LEFT JOIN g ON map_id = 'c' || c_custkey""")
def landmarks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    s = s.select(F.concat(F.lit("c"), "o_custkey").alias("map_id"), F.concat(F.lit("s"), "o_orderkey").alias("shorthand"), F.year("o_orderdate").alias("report_year"), F.col("o_orderstatus").alias("ea_regime"))
    p = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return enrich.landmarks(p, s).withColumn("citations", F.array_join("citations", "|"))


@query("""WITH d AS (SELECT o_orderkey AS k, 'T ' || o_orderkey || CASE o_orderkey % 2 WHEN 0 THEN ' (doc 12)' ELSE '' END AS title, CASE WHEN o_orderkey % 3 <> 0 THEN '2001-01-01' END AS date, CASE o_orderkey % 4 WHEN 0 THEN 'old' END AS au FROM orders),
m AS (SELECT o_orderkey AS k, CASE o_orderkey % 2 WHEN 0 THEN 'a' || o_orderkey END AS mau, CASE WHEN o_orderkey % 5 <> 1 THEN '2002-02-02' ELSE '' END AS mdd FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'u' || k AS url, CASE WHEN mdd <> '' AND date IS NULL THEN regexp_replace(title, ' \\(doc 12\\)$', '') ELSE title END AS title, CASE WHEN mdd <> '' AND date IS NULL THEN mdd ELSE date END AS date, coalesce(mau, au) AS archive_url FROM d LEFT JOIN m USING (k)""")
def archived_copies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    docs = o.select(F.concat(F.lit("u"), k).alias("url"), F.concat(F.lit("T "), k, F.when(k % 2 == 0, " (doc 12)").otherwise("")).alias("title"), F.when(k % 3 != 0, "2001-01-01").alias("date"), F.when(k % 4 == 0, "old").alias("archive_url"))
    m = o.where(k % 5 != 0).select(F.concat(F.lit("u"), k).alias("url"), F.when(k % 2 == 0, F.concat(F.lit("a"), k)).alias("archive_url"), F.when(k % 5 != 1, "2002-02-02").otherwise("").alias("doc_date"))
    return enrich.archived_copies(docs, m)


@query("""WITH p AS (SELECT * FROM customer WHERE c_custkey % 2 = 0)
SELECT o_orderkey, coalesce(a.c_mktsegment, b.c_mktsegment, 'other') AS archetype FROM orders JOIN customer c ON c.c_custkey = o_custkey
LEFT JOIN p a ON o_orderkey % 3 = 0 AND a.c_custkey = o_custkey LEFT JOIN p b ON o_orderkey % 3 = 1 AND b.c_name = c.c_name""")
def archetype_lookup(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), table(spark, d, "customer")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    docs = o.select("o_orderkey", F.when(k % 3 == 0, F.col("o_custkey").cast("string")).alias("project_id"), F.when(k % 3 == 1, F.upper("c_name")).alias("project"))
    p = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("https://x/p/"), "c_custkey").alias("registry_url"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"))
    return enrich.archetypes(docs, p, F.lit("other")).select("o_orderkey", "archetype")


@query("""WITH n AS (SELECT c_custkey AS name_id, CASE c_custkey % 3 WHEN 0 THEN lower(n_name) ELSE 'acme ' || lower(n_name) || ' power' END AS n FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT n_nationkey AS target, lower(n_name) AS v, n_nationkey AS o FROM nation UNION ALL SELECT 100 + r_regionkey, 'acme ' || lower(substr(n_name, 1, 2)), 50 + n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey),
h AS (SELECT name_id, target, CASE WHEN n = v THEN 0 ELSE 1 END AS tier, o FROM n JOIN v ON n = v OR (length(v) >= 6 AND contains(n, v)))
SELECT n.name_id, CAST(t AS BIGINT) AS target FROM n LEFT JOIN (SELECT name_id, arg_min(target, (tier, o)) AS t FROM h GROUP BY 1) USING (name_id)""")
def proponent_targets(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    names = c.select(F.col("c_custkey").alias("name_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat("n_name", F.lit(" Ltd."))).otherwise(F.concat(F.lit("ACME "), "n_name", F.lit(" (old) Power Inc"))).alias("name"))
    one = n.select(F.col("n_nationkey").cast("long").alias("target"), F.col("n_name").alias("variant"), F.col("n_nationkey").alias("ord"))
    two = n.select((F.col("n_regionkey") + 100).cast("long").alias("target"), F.concat(F.lit("Acme "), F.substring("n_name", 1, 2)).alias("variant"), (F.col("n_nationkey") + 50).alias("ord"))
    return enrich.variants_of(names, one.unionAll(two))


@query("SELECT n_nationkey, n_name, n_regionkey, 'R' || n_regionkey AS pid FROM nation")
def crosswalk_checked(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("R"), "r_regionkey").alias("pid"))
    return enrich.crosswalk(table(spark, d, "nation"), r, "n_regionkey", r.select("pid"), "pid").select("n_nationkey", "n_name", "n_regionkey", "pid")


@query("""WITH l(label, match) AS (VALUES ('A', 'gear'), ('B', 'red bolt'), ('C', 'no such'), ('D', 'Small'), ('E', 'idge'), ('F', 'e w'), ('G', 't')), e AS (SELECT p_partkey AS o, p_name AS title, 'l' || p_partkey AS link FROM part WHERE p_partkey % 3 <> 0)
SELECT label, arg_min(title, o) AS title, arg_min(link, o) AS link FROM l JOIN e ON contains(lower(title), lower(match)) GROUP BY 1""")
def layer_titles(spark: SparkSession, d: str) -> DataFrame:
    layers = spark.createDataFrame([("A", "gear"), ("B", "red bolt"), ("C", "no such"), ("D", "Small"), ("E", "idge"), ("F", "e w"), ("G", "t")], "label string, match string")
    k = F.col("p_partkey")
    return enrich.layer_titles(layers, table(spark, d, "part").select(k.alias("ord"), F.col("p_name").alias("title"), F.when(k % 3 != 0, F.concat(F.lit("l"), k)).otherwise("").alias("link")))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 25")
def federal_documents(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.concat(F.lit("https://r/proj/"), "o_custkey", F.lit("/document/"), "o_orderkey").alias("url"))
    o = enrich.lookup(o, text.group(F.col("url"), r"/proj/(\d+)/"), table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name"), "k", ["c_name"])
    return o.orderBy(*enrich.number_desc("url", r"/document/(\d+)$")).limit(25).select("o_orderkey", "c_name")


# ---- row rules

_FED = """SELECT o_orderkey AS ord, ['project','archive-project','archive-document','other'][o_orderkey % 4 + 1] AS document_type, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS project_id,
 CASE WHEN o_orderkey % 3 <> 0 THEN '\\a\\' || (o_orderkey % 50) END AS relative_path, CASE o_orderkey % 2 WHEN 0 THEN '  A  title ' || o_orderkey END AS title, CASE o_orderkey % 5 WHEN 1 THEN 'file ' || o_orderkey END AS file_name, CASE o_orderkey % 6 WHEN 2 THEN '' ELSE o_orderpriority END AS category FROM orders"""


def _federal(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("project", "archive-project", "archive-document", "other"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(
        k.alias("ord"), kind.alias("document_type"), F.when(k % 11 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("project_id"), F.when(k % 3 != 0, F.concat(F.lit("\\a\\"), k % 50)).alias("relative_path"),
        F.when(k % 2 == 0, F.concat(F.lit("  A  title "), k)).alias("title"), F.when(k % 5 == 1, F.concat(F.lit("file "), k)).alias("file_name"), F.when(k % 6 == 2, "").otherwise(F.col("o_orderpriority")).alias("category"),
    )


@query(f"""WITH f AS ({_FED}), r AS (SELECT *, document_type = 'archive-project' AS arch FROM f WHERE document_type IN ('project','archive-project') AND project_id <> '' AND (document_type = 'project' OR relative_path IS NOT NULL))
SELECT project_id, ord, CASE WHEN arch THEN 'https://iaac-aeic.gc.ca/archives/evaluations' || replace(relative_path, '\\', '/') ELSE 'https://iaac-aeic.gc.ca/050/evaluations/proj/' || project_id END AS registry_url, CASE WHEN arch THEN true END AS archived
FROM r QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ord) = 1""")
def registry_rows(spark: SparkSession, d: str) -> DataFrame:
    return enrich.registry_rows(_federal(spark, d)).select("project_id", "ord", "registry_url", "archived")


@query(f"""WITH f AS ({_FED}), r AS (SELECT project_id, ord, trim(regexp_replace(coalesce(nullif(title, ''), file_name, 'Document'), '\\s+', ' ', 'g')) AS title, coalesce(nullif(category, ''), 'Archived') AS category, 'https://iaac-aeic.gc.ca/archives/evaluations' || replace(relative_path, '\\', '/') AS url
FROM f WHERE document_type = 'archive-document' AND project_id <> '' AND relative_path IS NOT NULL) SELECT project_id, title, category, url FROM r QUALIFY row_number() OVER (PARTITION BY project_id, url ORDER BY ord) = 1""")
def archive_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return enrich.catalogue_of_archive(_federal(spark, d))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN NULL ELSE s_name END AS proponent FROM supplier")
def polymorphic_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    j = F.when(k == 0, F.concat(F.lit('{"proponent": {"name": "'), "s_name", F.lit('"}}'))).when(k == 1, F.concat(F.lit('{"proponent": "'), "s_name", F.lit('"}'))).otherwise('{"proponent": {"x": 1}}')
    return table(spark, d, "supplier").select("s_suppkey", enrich.name_or_value(j, "proponent").alias("proponent"))


_XY = "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '' ELSE '-' || s_suppkey || '.5' END AS lon, CASE s_suppkey % 7 WHEN 0 THEN NULL ELSE CAST(s_suppkey AS VARCHAR) END AS lat FROM supplier"


def _points(spark: SparkSession, d: str, drop: bool) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "").otherwise(F.concat(F.lit("-"), k, F.lit(".5"))).alias("lon"), F.when(k % 7 != 0, k.cast("string")).alias("lat"))
    return enrich.with_points(rows, "lon", "lat", drop)


@query(f"WITH p AS ({_XY}), c AS (SELECT s_suppkey, TRY_CAST(lon AS DOUBLE) AS x, TRY_CAST(lat AS DOUBLE) AS y FROM p) SELECT s_suppkey, x AS lon, y AS lat FROM c WHERE x IS NOT NULL AND y IS NOT NULL")
def points_or_none(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, True)


@query(f"WITH p AS ({_XY}), c AS (SELECT s_suppkey, TRY_CAST(lon AS DOUBLE) AS x, TRY_CAST(lat AS DOUBLE) AS y FROM p) SELECT s_suppkey, CASE WHEN y IS NOT NULL THEN x END AS lon, CASE WHEN x IS NOT NULL THEN y END AS lat FROM c")
def points_or_null(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d, False)


@query("SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN false END AS discard FROM part WHERE p_size % 3 <> 0")
def kept_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    return enrich.kept_labels(table(spark, d, "part").select("p_partkey", F.when(k == 0, True).when(k == 1, False).alias("discard")))


@query("SELECT page_id, regexp_matches(url, '" + enrich.NOISE.removeprefix("(?i)") + "', 'i') AS noise FROM pages")
def noise_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", enrich.noisy(F.col("url")).alias("noise"))


@query("SELECT page_id, CASE WHEN page_id % 5 IN (0, 1) THEN url WHEN page_id % 2 = 0 THEN 'f' || page_id ELSE url END AS link FROM pages")
def fallback_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    status = F.when(k % 5 == 0, 200).when(k % 5 == 1, 299).when(k % 5 == 2, 404).when(k % 5 == 3, 300)
    return table(spark, d, "pages").select("page_id", enrich.first_good(status, F.col("url"), F.when(k % 2 == 0, F.concat(F.lit("f"), k)).otherwise("")).alias("link"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1997-01-01' AND o_orderstatus <> 'F'")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("closed"))
    return enrich.between(o, "o_orderdate", "1995-01-01", "1997-01-01", "closed", show_active=False).select("o_orderkey")


@query("""WITH c AS (SELECT c_name, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_custkey % 100 ORDER BY c_custkey % 3 = 0 DESC, c_custkey) AS rn FROM customer)
SELECT c_custkey FROM c WHERE rn = 1""")
def prefer_named(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    docs = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (k % 100).alias("url"), F.when(k % 3 == 0, F.col("c_name")).otherwise("Download PDF").alias("title"))
    return dedupe.prefer_named(docs, ["c_mktsegment", "url"], "title", "c_custkey").select("c_custkey")


@query("""WITH f AS (SELECT p_partkey, lower(p_name) AS k FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1) SELECT k, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS n FROM f""")
def counted_firsts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", text.fold_latin(F.col("p_name")).alias("k"))
    return numbering.numbered(dedupe.keep_first(p, ["k"], ["p_partkey"]), ["p_partkey"]).select("k", F.col("n").cast("int").alias("n"))


@query("""WITH a AS (SELECT DISTINCT p_brand || '|' || p_size AS u FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey, p_brand || '|' || p_size AS u FROM part WHERE p_partkey % 2 = 1)
SELECT u, p_partkey FROM b QUALIFY row_number() OVER (PARTITION BY u ORDER BY p_partkey) = 1 AND u NOT IN (SELECT u FROM a)""")
def unseen_documents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_size").alias("u"))
    a, b = p.where("p_partkey % 2 = 0"), dedupe.keep_first(p.where("p_partkey % 2 = 1"), ["u"], ["p_partkey"])
    return merge.union_precedence(a, b, "u").where("p_partkey % 2 = 1").select("u", "p_partkey")


@query("""WITH l AS (SELECT o_custkey AS key, 'https://www.X.ca/Doc' || (o_orderkey % 9) || '/' AS url FROM orders WHERE o_orderkey % 2 = 0), w AS (SELECT o_custkey AS key, 'http://x.ca/doc' || (o_orderkey % 9) AS url FROM orders WHERE o_orderkey % 2 = 1),
b AS (SELECT *, 'live' AS source, 'x.ca/doc' || regexp_extract(url, 'oc(\\d)', 1) AS u FROM l UNION ALL SELECT *, 'wayback', 'x.ca/doc' || regexp_extract(url, 'oc(\\d)', 1) FROM w)
SELECT key, url, source FROM b QUALIFY row_number() OVER (PARTITION BY key, u ORDER BY source <> 'live', url) = 1""")
def inventories(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    live = o.where(k % 2 == 0).select(F.col("o_custkey").alias("key"), F.concat(F.lit("https://www.X.ca/Doc"), k % 9, F.lit("/")).alias("url"))
    old = o.where(k % 2 == 1).select(F.col("o_custkey").alias("key"), F.concat(F.lit("http://x.ca/doc"), k % 9).alias("url"))
    return enrich.inventories(live, old)


@query("""SELECT o_custkey % 50 AS u, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1""")
def seen_urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    docs = table(spark, d, "orders").select("o_orderkey", (k % 50).alias("u"), F.concat(F.when(k % 4 == 0, "ftp").otherwise("https"), F.lit("://x/"), k % 50).alias("url"))
    return enrich.seen_urls(docs, ["o_orderkey"]).select("u", "o_orderkey")


# ---- orders


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE v WHEN 'gap' THEN 0 WHEN 'weak' THEN 1 ELSE 2 END, coalesce(x, 0) DESC, o_orderkey) AS INTEGER) AS pos
FROM (SELECT o_orderkey, ['gap','weak','matched'][o_orderkey % 3 + 1] AS v, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE o_totalprice END AS x FROM orders)""")
def gap_order(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, ("gap", "weak", "matched"))), (k % 3 + 1).cast("int")).alias("verdict"), F.when(k % 4 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    return numbering.numbered(o, [*enrich.gaps_first(), "o_orderkey"], "pos").select("o_orderkey", F.col("pos").cast("int").alias("pos"))


_DT = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY d NULLS LAST, o_orderkey) AS INTEGER) AS first_pos, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(d, '') DESC, o_orderkey) AS INTEGER) AS last_pos FROM (SELECT *, {_DT} AS d FROM orders)")
def date_orders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    o = table(spark, d, "orders").withColumn("date", F.when(k == 1, "").when(k > 1, F.date_format("o_orderdate", "yyyy-MM-dd")))
    out = dedupe.numbered(o, ["o_custkey"], [*enrich.dated_first(), "o_orderkey"], "first_pos")
    return dedupe.numbered(out, ["o_custkey"], [*enrich.latest_first(), "o_orderkey"], "last_pos").select("o_orderkey", "first_pos", "last_pos")


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type IN ('view','click'), event_type, event_id) AS INTEGER) AS broken_pos, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', props, event_id) AS INTEGER) AS live_pos FROM events""")
def shown_orders(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("verdict", F.when(F.col("event_type").isin("view", "click"), "ok").otherwise("error")).withColumn("source", F.when(F.col("event_type") == "view", "live").otherwise("wayback"))
    out = dedupe.numbered(e, ["user_id"], [*enrich.broken_first("verdict", "event_type"), "event_id"], "broken_pos")
    return dedupe.numbered(out, ["user_id"], [*enrich.live_first("source", "props"), "event_id"], "live_pos").select("event_id", "broken_pos", "live_pos")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 9000 ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def top_above(spark: SparkSession, d: str) -> DataFrame:
    return predict.top_above(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 9000, 5, ["c_custkey"])


# ---- names, ids and texts


@query("SELECT 'A-' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '-b' WHEN 1 THEN '-bc' ELSE '' END AS id, 'A-' || c_custkey || CASE c_custkey % 3 WHEN 1 THEN '-bc' ELSE '' END AS base FROM customer")
def base_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(F.concat(F.lit("A-"), k, F.when(k % 3 == 0, "-b").when(k % 3 == 1, "-bc").otherwise("")).alias("id"))
    return c.select("id", enrich.base_id(F.col("id")).alias("base"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'transport' WHEN 1 THEN 'mining' WHEN 2 THEN 'wind' ELSE 'other' END AS archetype FROM customer")
def substring_archetypes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, "Life Support Zone").when(k == 1, "Gold Wind").when(k == 2, "West WIND Three").otherwise("Zzz")
    return table(spark, d, "customer").select("c_custkey", rules.archetype_of(name).alias("archetype"))


@query(r"""SELECT page_id, CASE page_id % 2 WHEN 0 THEN '2013-04-15' END AS doc_date, CASE page_id % 3 WHEN 0 THEN left('R ' || page_id, 40) END AS doc_ref, CASE page_id % 5 WHEN 0 THEN 'https://iaac-aeic.gc.ca/050/documents/p' || page_id || '.pdf' END AS file_url FROM pages""")
def federal_meta(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    page = F.concat(
        F.when(k % 2 == 0, '<META  name="Document Date" content="2013-04-15T00">').otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit("<strong>Document reference number: </strong> R "), k, F.lit(" <br>"))).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit("<a href='/050/documents/p"), k, F.lit(".pdf'>file</a>"))).otherwise(""),
    )
    found = enrich.federal_meta(page, F.lit("https://iaac-aeic.gc.ca/050/evaluations/document/7?x"))
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in found.items()])


_OWN_STOP = "'" + "','".join(sorted(text.DOCUMENT_STOP)) + "'"


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 5 AND t NOT IN ({_OWN_STOP})))) AS token FROM documents) SELECT doc_id, count(*) AS n FROM t GROUP BY 1")
def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(text.document_tokens(F.col("text"))).alias("token"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""SELECT i AS doc_id, k AS i, no AS condition_no, t AS section_title FROM (SELECT s_suppkey AS i FROM supplier), (VALUES (1, '3.2', NULL), (2, '3.3', 'Fish habitat and water'), (3, '3.1', 'Fish habitat and water'), (4, '4.1', 'Wildlife in the valley')) x(k, no, t)""")
def condition_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings that stand ahead of a later mark than ".1" count too."""
    body = " The proponent shall keep all of this in good order always. "
    page = "Preface 1.1 Not here. Conditions 3.1 Short. ; 3.2 " + body.strip() + " 3 Fish habitat and water. 3.3" + body + "3.1" + body + "4 Wildlife in the valley; 4.1" + body + "Issuance 5.1" + body
    return segment.marked_conditions(table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(page).alias("text"))).drop("body")


# ---- links and pages


def _skip_sql(url: str) -> str:
    return f"regexp_matches({url}, '{web.SKIP}', 'i')"


@query(f"SELECT page_id, NOT {_skip_sql('url')} AND (regexp_matches(url, '{web.STRONG}', 'i') OR (page_id % 3 <= 1 AND regexp_matches(url, '{web.WEAK}', 'i'))) AS followed FROM (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '/outage/mine' WHEN 1 THEN '/closure' WHEN 2 THEN '/wind' WHEN 3 THEN '/solar' WHEN 4 THEN '/safety-tips/permit' ELSE '/x.png' END AS url FROM pages)")
def followed_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    url = F.concat("url", F.when(k % 6 == 0, "/outage/mine").when(k % 6 == 1, "/closure").when(k % 6 == 2, "/wind").when(k % 6 == 3, "/solar").when(k % 6 == 4, "/safety-tips/permit").otherwise("/x.png"))
    return table(spark, d, "pages").select("page_id", web.followed(url, F.lit(None).cast("string"), k % 3).alias("followed"))


_GONE = web.GONE.replace("'", "''")


@query(f"SELECT page_id, page_id % 4 <> 0 AND regexp_matches(html || CASE page_id % 3 WHEN 0 THEN 'Site presentement en developpement' WHEN 1 THEN 'PAGE not found' ELSE '' END, '{_GONE}', 'i') AS gone FROM pages")
def gone_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    body = F.concat("html", F.when(k % 3 == 0, "Site presentement en developpement").when(k % 3 == 1, "PAGE not found").otherwise(""))
    return table(spark, d, "pages").select("page_id", web.soft_404(F.when(k % 4 == 0, 404).otherwise(200), body).alias("gone"))


# ---- matching with rare anchors, and with proponents


@query(f"WITH {_IDF}, anch AS (SELECT DISTINCT ext_id, our_id FROM (SELECT x.ext_id, ot.our_id FROM xt x JOIN ot USING (token) JOIN f USING (token) WHERE df <= 20)) SELECT ext_id, our_id, shared, round(mass, 6) AS mass FROM pr JOIN anch USING (ext_id, our_id)")
def coverage_rare_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Frequent tokens make no pairs, but weigh in the pairs that rare ones make."""
    ext, ours = _sides(spark, d)
    c = match.coverage(ext, ours, match.document_frequency(ours), ours.agg(F.count("*").alias("n")), 20)
    return c.select("ext_id", "our_id", "shared", F.round("mass", 6).alias("mass"))


@query("""WITH o AS (SELECT p_partkey AS our_id, list_distinct(string_split(p_name, ' ')) AS tok, list_distinct([lower(p_brand), lower(p_type)]) AS prop FROM part), x AS (SELECT s_suppkey AS ext_id, ['red', 'small', 'gizmo'] AS tok, ['brand#' || (s_suppkey % 25 + 1), 'promo'] AS prop FROM supplier),
n AS (SELECT count(*) AS n FROM o), ot AS (SELECT our_id, unnest(tok) AS token FROM o), idf AS (SELECT token, ln((any_value(n) + 1) / (count(*) + 1)) + 1.0 AS w FROM ot, n GROUP BY 1), xt AS (SELECT ext_id, u.token, coalesce(w, ln(n + 1.0) + 1.0) AS w FROM (SELECT ext_id, unnest(tok) AS token FROM x) u LEFT JOIN idf ON idf.token = u.token, n),
xp AS (SELECT ext_id, u.token, coalesce(w, ln(n + 1.0) + 1.0) AS w FROM (SELECT ext_id, unnest(prop) AS token FROM x) u LEFT JOIN idf ON idf.token = u.token, n), op AS (SELECT our_id, unnest(prop) AS token FROM o),
ns AS (SELECT ext_id, our_id, sum(xt.w) / any_value(em) AS ns FROM xt JOIN ot USING (token) JOIN (SELECT ext_id, sum(w) AS em FROM xt GROUP BY 1) USING (ext_id) GROUP BY 1, 2), pm AS (SELECT ext_id, sum(w) AS pm FROM xp GROUP BY 1), ps AS (SELECT ext_id, our_id, sum(w) AS h FROM xp JOIN op USING (token) GROUP BY 1, 2),
s AS (SELECT ext_id, our_id, ns, ns + 0.25 * coalesce(h, 0) / pm AS s FROM ns JOIN pm USING (ext_id) LEFT JOIN ps USING (ext_id, our_id)), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY ext_id ORDER BY round(s, 9) DESC, our_id) = 1)
SELECT ext_id, round(s, 6) AS score, round(ns, 6) AS name_score FROM b""")
def proponent_boost(spark: SparkSession, d: str) -> DataFrame:
    nowhere = F.lit(None).cast("double")
    ours = table(spark, d, "part").select(F.col("p_partkey").alias("our_id"), F.col("p_partkey").alias("ord"), F.array_distinct(F.split("p_name", " ")).alias("tok"), F.array_distinct(F.array(F.lower("p_brand"), F.lower("p_type"))).alias("prop_tok"), nowhere.alias("lon"), nowhere.alias("lat"))
    k = F.col("s_suppkey")
    ext = table(spark, d, "supplier").select(k.alias("ext_id"), F.array(*map(F.lit, ("red", "small", "gizmo"))).alias("tok"), F.array(F.concat(F.lit("brand#"), k % 25 + 1), F.lit("promo")).alias("prop_tok"), nowhere.alias("lon"), nowhere.alias("lat"))
    return match.best_match(ext, ours).select("ext_id", "score", "name_score")


# ---- checks


@query("SELECT 'fail' AS level, 'index' AS \"check\", 'documents' AS item, CAST(count(*) AS VARCHAR) AS message FROM documents HAVING count(*) < 100000 UNION ALL SELECT 'warn', 'major_gap', 'c' || c_custkey, CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) FROM customer WHERE c_acctbal >= 9900 AND c_custkey % 2 = 0 UNION ALL SELECT 'fail', 'crashed', 'broken', 'check failed'")
def checks_that_may_crash(spark: SparkSession, d: str) -> DataFrame:
    docs, c = table(spark, d, "documents"), table(spark, d, "customer")
    gaps = c.select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "gap").otherwise("matched").alias("verdict"), F.col("c_acctbal").alias("value"))

    def broken() -> DataFrame:
        raise RuntimeError("not there")

    found = quality.run_checks(spark, {"index": lambda: quality.least_rows(docs, "documents", 100_000), "gaps": lambda: quality.major_gaps(gaps, 9900), "broken": broken})
    return found.withColumn("message", F.when(F.col("check") == "crashed", "check failed").otherwise(F.col("message")))


@query("WITH p AS (SELECT p_partkey, p_brand, ['soils_terrain','no such','other'][p_partkey % 3 + 1] AS d FROM part) SELECT 'fail' AS level, 'discipline' AS \"check\", CAST(p_partkey AS VARCHAR) AS item, d AS message FROM p WHERE d = 'no such'")
def prediction_enums(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), F.element_at(F.array(*map(F.lit, ("soils_terrain", "no such", "other"))), (k % 3 + 1).cast("int")).alias("discipline"), F.lit("avoidance").alias("measure_type"), F.lit(None).cast("string").alias("timing"))
    return quality.predictions(p)


@query("SELECT coalesce(f, '-') AS source, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS f FROM orders) WHERE f IS NULL OR f <> '1-URGENT' GROUP BY 1")
def without_overlay(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("source"))
    return merge.without(o, "source", "1-URGENT").groupBy(F.coalesce("source", F.lit("-")).alias("source")).agg(F.count("*").alias("n"))


@query("""WITH r(trigger, km, discipline) AS (VALUES ('R0', 300.0, 'wetlands'), ('R1', 150.0, 'noise'), ('R2', 50.0, 'noise')), s AS (SELECT s_suppkey AS k, s_nationkey % 3 AS kind, -140.0 + (s_suppkey * 7919) % 8700 / 100.0 AS lon, 42.0 + (s_suppkey * 104729) % 4100 / 100.0 AS lat FROM supplier),
p AS (SELECT c_custkey AS k, -140.0 + (c_custkey * 7919) % 8700 / 100.0 AS lon, 42.0 + (c_custkey * 104729) % 4100 / 100.0 AS lat FROM customer)
SELECT p.k AS point_id, discipline, count(*) AS features FROM p, s JOIN r ON trigger = 'R' || kind WHERE 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) <= km GROUP BY 1, 2""")
def triggered_disciplines(spark: SparkSession, d: str) -> DataFrame:
    def places(name: str, key: str) -> DataFrame:
        lon, lat = lonlat(F.col(key))
        return table(spark, d, name).withColumn("lon", lon).withColumn("lat", lat)

    table_ = spark.createDataFrame([("R0", 300.0, "wetlands"), ("R1", 150.0, "noise"), ("R2", 50.0, "noise")], "kind string, km double, discipline string")
    features = places("supplier", "s_suppkey").select(F.concat(F.lit("R"), F.col("s_nationkey") % 3).alias("kind"), "lon", "lat")
    points = places("customer", "c_custkey").select(F.col("c_custkey").alias("point_id"), "lon", "lat")
    return spatial.triggered(points, features, table_)


@query(f"""WITH b AS (SELECT c_name AS project, o_orderpriority AS v FROM orders JOIN customer ON c_custkey = o_custkey) SELECT v AS value, count(*) AS n FROM b WHERE v NOT IN ('1-URGENT') GROUP BY 1 HAVING count(*) >= 3""")
def recurring_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return predict.recurring(table(spark, d, "orders").select("o_orderpriority"), "o_orderpriority", ["1-URGENT"], 3)



# ---- hosts that refuse


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS host, list({'seq': event_id, 'at': epoch_us(ts) / 1e6, 'url': 'u' || (event_id % 5), 'verdict': CASE event_type WHEN 'error' THEN 'http_error' WHEN 'signup' THEN 'error' ELSE 'ok' END, 'no': user_id % 5 > 0 AND value < 10} ORDER BY ts, event_id) AS ps FROM events GROUP BY 1),
f AS (SELECT host, list_reduce(ps, lambda s, p: list_transform([CASE WHEN s.until IS NOT NULL AND p.at >= s.until THEN {'hits': 0::BIGINT, 'until': NULL::DOUBLE, 'open': []::VARCHAR[], 'out': s.out} ELSE s END],
  lambda w: list_transform([CASE WHEN w.until IS NOT NULL THEN 'skipped' WHEN p.no AND (w.hits + 1) % 4 = 0 THEN 'dropped' WHEN p.no AND p.verdict = 'http_error' THEN 'refused' WHEN p.verdict = 'ok' THEN 'ok' ELSE 'failed' END],
    lambda a: {'hits': CASE WHEN a = 'skipped' THEN w.hits ELSE w.hits + 1 END, 'until': CASE WHEN a IN ('dropped', 'refused') THEN p.at + 21600 ELSE w.until END,
      'open': CASE WHEN a IN ('dropped', 'refused') THEN [] WHEN a = 'ok' THEN list_filter(w.open, lambda u: u <> p.url) WHEN a = 'failed' THEN list_distinct(list_append(w.open, p.url)) ELSE w.open END,
      'out': list_append(w.out, {'seq': p.seq, 'url': p.url, 'action': a, 'withdrawn': CASE WHEN a IN ('dropped', 'refused') THEN len(w.open) ELSE 0 END})})[1])[1],
  {'hits': 0::BIGINT, 'until': NULL::DOUBLE, 'open': []::VARCHAR[], 'out': []::STRUCT(seq BIGINT, url VARCHAR, action VARCHAR, withdrawn BIGINT)[]}).out AS out FROM e)
SELECT host, o.seq, o.url, o.action, CAST(o.withdrawn AS INTEGER) AS withdrawn FROM (SELECT host, unnest(out) AS o FROM f)""")
def host_canaries(spark: SparkSession, d: str) -> DataFrame:
    """Users as hosts, six hours of rest; nothing is given up, so that SQL can say it."""
    e, k = table(spark, d, "events"), F.col("event_id")
    verdict = F.when(F.col("event_type") == "error", "http_error").when(F.col("event_type") == "signup", "error").otherwise("ok")
    probes = e.select(F.col("user_id").cast("string").alias("host"), F.col("ts").alias("at"), k.alias("seq"), F.concat(F.lit("u"), k % 5).alias("url"), verdict.alias("verdict"), F.when(F.col("user_id") % 5 > 0, F.col("value") >= 10).alias("canary"))
    return hosts.replay(probes, every=4, give_up=1_000_000, rest=21600.0).drop("fails")
