"""Registered queries over the driver's tables, each with its DuckDB statement
where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, rules, text, web
from .operators import archive, blocks, crawl, dedupe, footprint, links, match, merge, numbering, predict, quality, route, search, segment, spatial
from .plans import projects as P
from .plans.tables import conditions, projects, table
from .sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracle[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


# ---- registers of precedents

_COND = """cond AS (SELECT c_name AS project, CAST(o_custkey AS VARCHAR) AS project_id, c_mktsegment AS archetype, r_name AS jurisdiction, p_type AS discipline,
  p_brand AS secondary, l_returnflag || l_linestatus AS measure_type, CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_orderpriority END AS timing,
  p_name AS measure_text, CAST(l_orderkey AS VARCHAR) AS source_doc, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey % 1000000 AS ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_HIT = "(discipline IN ('ECONOMY','PROMO','LARGE') OR secondary IN ('Brand#3'))"
_FIRED = ["ECONOMY", "PROMO", "LARGE", "Brand#3"]


def _register_sql(pool: str) -> str:
    return f"""WITH {_COND}, pool AS (SELECT * FROM cond WHERE {pool} AND {_HIT}),
base AS (SELECT greatest(count(DISTINCT project_id), 1) AS n FROM cond WHERE archetype = 'MACHINERY'),
g AS (SELECT discipline, measure_type, count(DISTINCT project) AS precedent_projects, min(ord) AS first_ord, arg_min(measure_text, ord) AS sample_condition,
  arg_min(source_doc, ord) AS sample_source, array_to_string(list_sort(list_distinct(list(project)))[1:4], '|') AS examples FROM pool GROUP BY 1, 2),
t AS (SELECT discipline, measure_type, timing, row_number() OVER (PARTITION BY discipline, measure_type ORDER BY count(*) DESC, min(ord)) AS rn FROM pool WHERE timing IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT discipline, measure_type, string_agg(jurisdiction || '=' || n, ',' ORDER BY jurisdiction) AS jurisdictions FROM (SELECT discipline, measure_type, jurisdiction, count(*) AS n FROM pool GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT g.discipline, g.measure_type, precedent_projects, first_ord, sample_condition, sample_source, examples, t.timing AS typical_timing, jurisdictions,
  precedent_projects || '/' || n || ' comparable projects' AS frequency
FROM g JOIN j USING (discipline, measure_type) LEFT JOIN t ON t.discipline = g.discipline AND t.measure_type = g.measure_type AND rn = 1 CROSS JOIN base"""


def _flat_register(r: DataFrame) -> DataFrame:
    where = F.array_join(F.transform(F.map_entries("jurisdictions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r.withColumn("examples", F.array_join("examples", "|")).withColumn("jurisdictions", where)


@query(_register_sql("archetype = 'MACHINERY'"))
def register_predict(spark: SparkSession, d: str) -> DataFrame:
    return _flat_register(predict.register(conditions(spark, d), "MACHINERY", _FIRED))


@query(_register_sql("archetype <> 'MACHINERY'"))
def register_weak(spark: SparkSession, d: str) -> DataFrame:
    return _flat_register(predict.register(conditions(spark, d), "MACHINERY", _FIRED, strong=False))


@query(f"WITH {_COND} SELECT array_to_string(list_sort(list_distinct(list(discipline))), ',') AS fired, count(*) AS n FROM cond WHERE {_HIT} AND jurisdiction IN ('ASIA','EUROPE')")
def fired_disciplines(spark: SparkSession, d: str) -> DataFrame:
    c = conditions(spark, d).where(F.col("jurisdiction").isin("ASIA", "EUROPE")).where(predict.hits(_FIRED))
    return c.agg(F.array_join(F.array_sort(F.collect_set("discipline")), ",").alias("fired"), F.count("*").alias("n"))


@query(f"WITH {_COND} SELECT archetype = 'MACHINERY' AS strong, count(*) AS n, count(DISTINCT project) AS projects FROM cond WHERE {_HIT} GROUP BY 1")
def weak_pool_size(spark: SparkSession, d: str) -> DataFrame:
    return conditions(spark, d).where(predict.hits(_FIRED)).groupBy((F.col("project_archetype") == "MACHINERY").alias("strong")).agg(F.count("*").alias("n"), F.countDistinct("project").alias("projects"))


@query(f"WITH {_COND} SELECT discipline, count(*) AS n, count(DISTINCT project) AS projects FROM cond WHERE archetype = 'BUILDING' GROUP BY 1 ORDER BY n DESC, discipline LIMIT 5")
def bridge_top5(spark: SparkSession, d: str) -> DataFrame:
    return predict.top_counts(conditions(spark, d).where("project_archetype = 'BUILDING'"), "discipline", 5, projects=F.countDistinct("project"))


@query(f"WITH {_COND} SELECT discipline, count(*) AS n FROM cond WHERE project = 'Customer#000000007' GROUP BY 1")
def obligation_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return predict.fingerprint(conditions(spark, d), F.col("project") == "Customer#000000007")


@query(f"WITH {_COND} SELECT coalesce(timing, 'none') AS timing, count(*) AS n, count(DISTINCT discipline) AS disciplines FROM cond GROUP BY 1")
def timeline_lens(spark: SparkSession, d: str) -> DataFrame:
    return predict.by_timing(conditions(spark, d))


_FOUR = ["Customer#000000001", "Customer#000000002", "Customer#000000003", "Customer#000000004"]


@query(f"WITH {_COND} SELECT discipline, " + ", ".join(f"count(*) FILTER (project = '{p}') AS p{i}" for i, p in enumerate(_FOUR)) + f" FROM cond WHERE project IN ({', '.join(repr(p) for p in _FOUR)}) GROUP BY 1")
def compare_pivot(spark: SparkSession, d: str) -> DataFrame:
    return predict.compare(conditions(spark, d), _FOUR)


@query(f"""WITH {_COND}, f AS (SELECT discipline, measure_type, count(DISTINCT project) AS n FROM cond WHERE archetype = 'FURNITURE' GROUP BY 1, 2),
p(discipline, measure_type) AS (VALUES ('ECONOMY','RF'),('ECONOMY','XX'),('PROMO','NO'),('LARGE','ZZ'))
SELECT p.discipline, p.measure_type, n AS precedent_projects, CASE WHEN n IS NULL THEN 'expected (no precedent match yet)' END AS flag FROM p LEFT JOIN f USING (discipline, measure_type)""")
def priors_overlay(spark: SparkSession, d: str) -> DataFrame:
    priors = spark.createDataFrame([("ECONOMY", "RF"), ("ECONOMY", "XX"), ("PROMO", "NO"), ("LARGE", "ZZ")], "discipline string, measure_type string")
    found = conditions(spark, d).where("project_archetype = 'FURNITURE'").groupBy("discipline", "measure_type").agg(F.countDistinct("project").alias("precedent_projects"))
    return predict.priors_overlay(priors, found)


@query("SELECT props AS value, count(*) AS n FROM events WHERE props IS NOT NULL AND props <> '{\"k\": 1}' GROUP BY 1 HAVING count(*) >= 3")
def recurring_values(spark: SparkSession, d: str) -> DataFrame:
    return predict.recurring(table(spark, d, "events"), "props", ['{"k": 1}'], 3)


# ---- rules

_PART_RULES = (("metal", ("bolt", "gear", "anvil")), ("sheet", ("plate", "rod")), ("small", ("ring", "gizmo")))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\bbolt|\bgear|\banvil') THEN 'metal' WHEN regexp_matches(p_name, '\bplate|\brod\b') THEN 'sheet' WHEN regexp_matches(p_name, '\bring\b|\bgizmo') THEN 'small' ELSE 'other' END AS category FROM part""")
def categorize_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", rules.first_match(F.lower("p_name"), rules.word_rules(_PART_RULES, ("rod", "ring")), ignore_case=False).alias("category"))


_DOC_RULES = ((r"licen[cs]e", "permit_approval"), (r"copyright|rights reserved", "notice"), (r"@[a-z]+\.", "contact"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'permit_approval' WHEN regexp_matches(text, '(?i)copyright|rights reserved') THEN 'notice' WHEN regexp_matches(text, '(?i)@[a-z]+\.') THEN 'contact' ELSE 'other' END AS kind FROM documents""")
def doc_type_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.first_match(F.col("text"), _DOC_RULES).alias("kind"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '\.html') THEN 1 WHEN regexp_matches(url, '/$') THEN 2 WHEN regexp_matches(url, 'utm_|page=') THEN 3 ELSE 9 END AS tier FROM pages""")
def tier_of(spark: SparkSession, d: str) -> DataFrame:
    tiers = ((r"\.html", 1), ("/$", 2), ("utm_|page=", 3))
    return table(spark, d, "pages").select("page_id", rules.by_tier(F.col("url"), tiers, 9).alias("tier"))


_KEYWORDS = (("english", ("the ", " and ", " of ")), ("french", (" le ", " la ", " de ")), ("german", (" der ", " die ", " und ")), ("spanish", (" el ", " que ", " los ")))
_COUNT = lambda k: f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)}"


@query("WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, " + ", ".join(f"{' + '.join(map(_COUNT, ks))} AS s{i}" for i, (_, ks) in enumerate(_KEYWORDS)) + " FROM d) SELECT doc_id, CASE greatest(s0, s1, s2, s3) WHEN 0 THEN 'other' WHEN s0 THEN 'english' WHEN s1 THEN 'french' WHEN s2 THEN 'german' ELSE 'spanish' END AS label FROM s")
def keyword_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.best_keywords(F.col("text"), _KEYWORDS, "other").alias("label"))


# ---- duplicates, titles, ids


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1")
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_first(table(spark, d, "documents").select("doc_id", "source", F.xxhash64("text").alias("a"), F.sha2("text", 256).alias("b")), ["source", "a", "b"], ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY left(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 400) ORDER BY doc_id) = 1")
def dedupe_norm400(spark: SparkSession, d: str) -> DataFrame:
    key = F.substring(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""), 1, 400)
    return table(spark, d, "documents").groupBy(key).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_last(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query('WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) SELECT count(*) AS "groups", CAST(sum(n - 1) AS BIGINT) AS extra, CAST(sum(n) AS BIGINT) AS rows_shared FROM g')
def dedupe_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.duplicate_mass(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), ["h"])


_PAGE_URL = "regexp_replace(url, '[?#].*$', '')"
_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"


@query(f"""WITH p AS (SELECT page_id AS ord, regexp_extract({_PAGE_URL}, '^[a-z]+://([^/]*)', 1) AS host, {_TITLE} AS title, regexp_extract(url, '/([a-z]{{2}})/', 1) AS lang FROM pages)
SELECT host, min(ord) AS ord, arg_max(title, [CASE WHEN title = '' THEN 0 ELSE 1 END, length(title), -ord]) AS title, arg_min(lang, ord) FILTER (lang <> '') AS lang FROM p GROUP BY host""")
def best_title_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.col("page_id").alias("ord"), text.host(F.col("url")).alias("host"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))
    return dedupe.merge_by_url(p, "host", fields=["lang"])


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '/([a-z]{{2}})/', 1) AS title, CAST(page_id % 3 AS VARCHAR) AS date,
  nullif(regexp_extract({_PAGE_URL}, '/([0-9]+)(?:\\.html|/)?$', 1), '') AS tag FROM pages),
n AS (SELECT *, count(*) OVER w AS n, count(tag) OVER w AS tags, row_number() OVER (PARTITION BY host, title, date ORDER BY page_id) AS i FROM p WINDOW w AS (PARTITION BY host, title, date)),
u AS (SELECT host, title, date, count(DISTINCT tag) AS distinct_tags FROM p GROUP BY 1, 2, 3)
SELECT n.page_id, CASE WHEN n = 1 THEN n.title WHEN tags = n AND distinct_tags = n THEN n.title || ' (' || tag || ')' ELSE n.title || ' (' || i || ' of ' || n || ')' END AS new_title FROM n JOIN u USING (host, title, date)""")
def disambiguate_titles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", text.host(F.col("url")).alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("title"), (F.col("page_id") % 3).cast("string").alias("date"), F.regexp_replace("url", r"[?#].*$", "").alias("u"))
    tag = F.regexp_extract("u", r"/([0-9]+)(?:\.html|/)?$", 1)
    return dedupe.disambiguate(p, ["host"], "title", "date", "page_id", [tag]).select("page_id", "new_title")


@query("SELECT p_partkey, 'p-' || left(md5(p_name), 2) || repeat('x', CAST(row_number() OVER (PARTITION BY left(md5(p_name), 2) ORDER BY p_partkey) - 1 AS INTEGER)) AS unique_id FROM part")
def collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("p-"), F.substring(F.md5("p_name"), 1, 2)).alias("id"))
    return dedupe.collision_suffix(p, "id", ["p_partkey"]).select("p_partkey", "unique_id")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'bu' WHEN 'MACHINERY' THEN 'ma' ELSE 'x' END || '-' || left(md5(c_mktsegment || '||' || c_name), 10) AS id FROM customer")
def make_id_md5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.make_id(F.col("c_mktsegment"), F.col("c_name"), {"BUILDING": "bu", "MACHINERY": "ma"}).alias("id"))


# ---- merges and unions


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), l AS (SELECT doc_id AS lab, quality, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels)
SELECT count(*) FILTER (lab = doc_id) AS good, count(*) FILTER (lab IS DISTINCT FROM doc_id) AS rejected FROM s LEFT JOIN l USING (pos)""")
def positional_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = numbering.numbered(table(spark, d, "documents").select("doc_id"), ["doc_id"]).select("doc_id", (F.col("n") - 1).alias("pos"))
    shards = numbering.shards(table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], 250)
    good, bad = merge.positional(docs, shards, 250, "doc_id")
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("rejected")))


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('ECONOMY','LARGE','MEDIUM','PROMO') OR p_type = 'LARGE' AND p_size > 40")
def enum_rejects(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    bad = quality.violations(p, F.col("p_partkey"), [("fail", "type", ~F.col("p_type").isin("ECONOMY", "LARGE", "MEDIUM", "PROMO"), F.col("p_type")), ("fail", "size", (F.col("p_type") == "LARGE") & (F.col("p_size") > 40), F.col("p_type"))])
    return bad.select(F.col("item").cast("long").alias("p_partkey"), F.col("message").alias("p_type"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return merge.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def source_union_precedence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return merge.union_precedence(s, c, "key")


@query("""WITH e AS (SELECT event_id, 'u' || user_id AS url, event_type, ts, value FROM events),
r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, url, arg_max(CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END, event_id) AS k0, max(event_id) AS m FROM e GROUP BY 1, 2),
m AS (SELECT side, e.url, CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS key, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS fetched_at, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS fails,
  CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) END AS doc_date FROM r JOIN e ON e.event_id = r.m AND e.url = r.url),
j AS (SELECT coalesce(a.url, b.url) AS url, a.key AS ak, b.key AS bk, a.fetched_at AS af, b.fetched_at AS bf, coalesce(a.fails, 0) AS x, coalesce(b.fails, 0) AS y, a.doc_date AS ad, b.doc_date AS bd,
  a.url IS NULL OR (b.url IS NOT NULL AND ((b.key IS NOT NULL AND a.key IS NULL) OR ((a.key IS NULL) = (b.key IS NULL) AND coalesce(b.fetched_at, '') > coalesce(a.fetched_at, '')))) AS s
  FROM (SELECT * FROM m WHERE side = 'a') a FULL JOIN (SELECT * FROM m WHERE side = 'b') b ON a.url = b.url)
SELECT url, CASE WHEN s THEN bk ELSE ak END AS key, CASE WHEN s THEN bf ELSE af END AS fetched_at, greatest(x, y) AS fails, CASE WHEN s THEN coalesce(bd, ad) ELSE coalesce(ad, bd) END AS doc_date FROM j""")
def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_manifests(*[_manifest(spark, d).where(F.col("event_id") % 2 == i).drop("event_id") for i in (0, 1)])


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = dedupe.keep_last(e.withColumn("side", F.col("event_id") % 2), ["user_id", "side"], ["event_id"])
    is_ = lambda t: F.when(F.col("event_type") == t, F.col("event_id").cast("string"))
    return last.select("event_id", F.concat(F.lit("u"), "user_id").alias("url"), is_("purchase").alias("key"), F.substring(F.col("ts").cast("string"), 1, 10).alias("fetched_at"), (F.col("event_type") == "error").cast("int").alias("fails"), is_("view").alias("doc_date"))


@query("SELECT user_id, arg_min(event_id, event_id) FILTER (event_type = 'error') AS first_error, arg_min(value, event_id) FILTER (value > 100) AS big FROM events GROUP BY 1")
def manifest_coalesce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("first_error"), F.when(F.col("value") > 100, F.col("value")).alias("big"))
    return merge.coalesce_parts(e, "user_id", "event_id", ["first_error", "big"])


@query("""WITH m AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS fails, max(CASE WHEN event_type = 'purchase' AND value > 300 THEN 'k' END) AS key FROM events GROUP BY 1)
SELECT 'u' || c_custkey AS url FROM customer LEFT JOIN m ON c_custkey = user_id WHERE key IS NULL AND coalesce(fails, 0) < 4""")
def worklist(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("url")).agg(F.count_if(F.col("event_type") == "error").cast("int").alias("fails"), F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 300), "k")).alias("key"))
    return merge.work_list(table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("url")), m)


@query("SELECT user_id, fails, fails >= 14 AS given_up FROM (SELECT user_id, count(*) FILTER (event_type = 'error' AND value < 100) AS fails FROM events GROUP BY 1)")
def retry_giveup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("value") < 100)).alias("fails"))
    return e.withColumn("given_up", F.col("fails") >= 14)


@query("""WITH a AS (SELECT user_id, event_type FROM events WHERE event_id % 3 < 2), b AS (SELECT user_id, event_type FROM events WHERE event_id % 3 > 0)
SELECT user_id, event_type, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT user_id, event_type, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return merge.changes(*[e.where(c).select("user_id", "event_type") for c in ("event_id % 3 < 2", "event_id % 3 > 0")])


# ---- projects


@query("SELECT a.c_custkey, b.s_suppkey FROM customer a JOIN supplier b ON lower(replace(c_name, 'Customer', 'X')) = lower(replace(s_name, 'Supplier', 'X'))")
def folded_name_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", text.fold_latin(F.replace("c_name", F.lit("Customer"), F.lit("X"))).alias("f"))
    s = table(spark, d, "supplier").select("s_suppkey", text.fold_latin(F.replace("s_name", F.lit("Supplier"), F.lit("X"))).alias("f"))
    return c.join(s, "f").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, CASE WHEN n_lines > 30 THEN 3 WHEN n_orders > 0 THEN 2 ELSE 1 END AS depth FROM (SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def depth_tier(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    c = table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", P.depth_tier(F.coalesce("lines", F.lit(0)) - 30, F.col("n")).alias("depth"))


@query("SELECT facet, value, count(*) AS n FROM (SELECT 'c_mktsegment' AS facet, c_mktsegment AS value FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY 1, 2")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return footprint.facet_counts(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('ECONOMY','SMALL') AND p_size IN (1, 2, 3, 4) ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20")
def facet_filter_page(spark: SparkSession, d: str) -> DataFrame:
    p = footprint.facet_filter(table(spark, d, "part"), {"p_type": ["ECONOMY", "SMALL"], "p_size": [1, 2, 3, 4]})
    return footprint.page(p, [F.desc("p_retailprice"), "p_partkey"], 2, 20).select("p_partkey", "p_type", "p_size")


@query("SELECT 'p_type' AS dropped, count(*) AS n FROM part WHERE p_brand IN ('Brand#1') AND p_size IN (1) UNION ALL SELECT 'p_brand', count(*) FROM part WHERE p_type IN ('PROMO') AND p_size IN (1) UNION ALL SELECT 'p_size', count(*) FROM part WHERE p_type IN ('PROMO') AND p_brand IN ('Brand#1')")
def facet_relaxations(spark: SparkSession, d: str) -> DataFrame:
    return footprint.relaxations(table(spark, d, "part"), {"p_type": ["PROMO"], "p_brand": ["Brand#1"], "p_size": [1]})


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new_act' WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'act_a' ELSE 'act_b' END AS framework,
 CASE o_orderstatus WHEN 'F' THEN 'decision' END AS stage, CASE WHEN o_orderstatus = 'F' THEN 4 WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderpriority = '5-LOW' THEN 5 END AS macro,
 CASE WHEN o_orderstatus <> 'F' AND o_orderpriority = '5-LOW' THEN 'withdrawn' END AS outcome,
 CASE WHEN o_orderstatus = 'F' THEN 'e' WHEN o_orderpriority IN ('1-URGENT','5-LOW') THEN 'i' ELSE 'u' END AS confidence FROM orders JOIN customer ON o_custkey = c_custkey""")
def process_state(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("framework_key"), F.col("o_orderstatus").alias("phase"), F.col("o_orderpriority").alias("status"))
    kinds = [(s, "act_a" if s in ("BUILDING", "MACHINERY") else "act_b") for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]
    f = spark.createDataFrame(kinds, "framework_key string, framework string")
    p = spark.createDataFrame([("F", "new_act", "decision", 4)], "phase string, framework string, stage string, macro int")
    s = spark.createDataFrame([("1-URGENT", 2, None), ("5-LOW", 5, "withdrawn")], "status string, macro int, outcome string")
    return P.process_state(rows, f, p, s).select("o_orderkey", "framework", "stage", "macro", "outcome", "confidence")


# ---- matching

_BENCH_TOK = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 4)"
_IDF = f"""o AS (SELECT doc_id AS our_id, list_distinct({_BENCH_TOK}) AS tok, doc_id % 7 AS r FROM documents), x AS (SELECT item_id AS ext_id, list_distinct({_BENCH_TOK}) AS tok, item_id % 7 AS r FROM benchmark),
n AS (SELECT count(*) AS n FROM o), ot AS (SELECT our_id, unnest(tok) AS token FROM o), f AS (SELECT token, count(*) AS df FROM ot GROUP BY 1), idf AS (SELECT token, df, ln((n + 1) / (df + 1)) + 1.0 AS idf FROM f, n),
xt AS (SELECT ext_id, u.token, coalesce(idf, ln(n + 1.0) + 1.0) AS idf FROM (SELECT ext_id, unnest(tok) AS token FROM x) u LEFT JOIN idf ON idf.token = u.token, n),
xm AS (SELECT ext_id, sum(idf) AS em FROM xt GROUP BY 1), om AS (SELECT our_id, sum(idf) AS om FROM ot JOIN idf USING (token) GROUP BY 1),
pr AS (SELECT ext_id, our_id, count(*) AS shared, sum(idf) AS mass FROM xt JOIN ot USING (token) GROUP BY 1, 2)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tok = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: F.length(t) >= 4))
    empty = F.array().cast("array<string>")

    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        lon, lat = (-140.0 + (F.col(key) * 13) % 80, 42.0 + (F.col(key) * 7) % 40)
        return df.select(F.col(key).alias(name), F.col(key).alias("ord"), tok.alias("tok"), empty.alias("prop_tok"), lon.alias("lon"), lat.alias("lat"), (F.col(key) % 7).alias("region"))

    return side(table(spark, d, "benchmark"), "item_id", "ext_id"), side(table(spark, d, "documents"), "doc_id", "our_id")


@query(f"WITH {_IDF} SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return match.document_frequency(_sides(spark, d)[1]).withColumn("idf", F.round("idf", 6))


_BEST = f"""WITH {_IDF}, k AS (SELECT ext_id, our_id, mass / em AS ns, 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians((42.0 + (our_id * 7) % 40) - (42.0 + (ext_id * 7) % 40)) / 2), 2)
  + cos(radians(42.0 + (ext_id * 7) % 40)) * cos(radians(42.0 + (our_id * 7) % 40)) * pow(sin(radians((our_id * 13) % 80 - (ext_id * 13) % 80) / 2), 2)))) AS km FROM pr JOIN xm USING (ext_id)),
s AS (SELECT ext_id, our_id, ns, ns + CASE WHEN km <= 10 THEN 0.20 WHEN km <= 35 THEN 0.10 WHEN km > 150 AND ns < 0.72 THEN -0.15 ELSE 0.0 END AS s FROM k),
b AS (SELECT * FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY ext_id ORDER BY round(s, 9) DESC, our_id) = 1),
r AS (SELECT x.ext_id, b.our_id, round(coalesce(s, 0), 6) AS score, round(coalesce(ns, 0), 6) AS name_score FROM x LEFT JOIN b USING (ext_id))"""
_VERDICT = "CASE WHEN score >= 0.72 AND name_score >= 0.50 THEN 'matched' WHEN score >= 0.40 THEN 'weak' ELSE 'gap' END"


@query(f"{_BEST} SELECT *, {_VERDICT} AS verdict FROM r")
def gap_best_match(spark: SparkSession, d: str) -> DataFrame:
    return match.best_match(*_sides(spark, d))


@query(f"{_BEST} SELECT CASE WHEN ext_id IN (3, 5) THEN 'gap' ELSE {_VERDICT} END AS verdict, count(*) AS n, count(*) FILTER (ext_id IN (3, 5)) AS overridden FROM r GROUP BY 1")
def gap_verdict(spark: SparkSession, d: str) -> DataFrame:
    forced = spark.createDataFrame([(3, "gap"), (5, "gap")], "ext_id long, forced string")
    r = match.best_match(*_sides(spark, d)).join(forced, "ext_id", "left")
    return r.groupBy(F.coalesce("forced", "verdict").alias("verdict")).agg(F.count("*").alias("n"), F.count("forced").alias("overridden"))


@query(f"""WITH {_IDF}, c AS (SELECT ext_id, our_id, mass / em AS a, mass / om AS b FROM pr JOIN xm USING (ext_id) JOIN om USING (our_id) WHERE shared >= 2 AND ext_id % 7 = our_id % 7),
s AS (SELECT ext_id, our_id, round((a + b) / 2, 9) AS s FROM c WHERE greatest(a, b) >= 0.5 AND least(a, b) >= 0.2), b AS (SELECT ext_id, our_id, round(s, 3) AS score FROM s QUALIFY row_number() OVER (PARTITION BY ext_id ORDER BY s DESC, our_id) = 1)
SELECT our_id, ext_id, score FROM b QUALIFY row_number() OVER (PARTITION BY our_id ORDER BY score DESC, ext_id) = 1""")
def enrich_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return match.bidirectional(*_sides(spark, d), max_side=0.5, min_side=0.2)


@query("""WITH p AS (SELECT p_partkey // 4 AS owner, p_partkey AS project_id, unnest(list_distinct(list_append(string_split(p_name, ' '), lower(p_type)))) AS token FROM part),
f AS (SELECT owner, token, count(*) AS freq FROM p GROUP BY 1, 2),
dd AS (SELECT p_partkey // 4 AS owner, l_orderkey * 1000000000 + l_partkey * 10 + l_linenumber AS doc_id, any_value(p_name) AS name, any_value(lower(p_type)) AS folder FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
h AS (SELECT owner, doc_id, project_id, count(*) AS hits, bool_or(freq <= 2) AS rare, bool_or(length(token) >= 8 AND freq <= 3) AS telling FROM (SELECT owner, doc_id, unnest(list_distinct(string_split(name, ' '))) AS token FROM dd) JOIN p USING (owner, token) JOIN f USING (owner, token) GROUP BY 1, 2, 3),
m AS (SELECT owner, doc_id, project_id, hits FROM h WHERE (hits >= 2 AND rare) OR (hits = 1 AND telling)),
i AS (SELECT dd.owner, doc_id, project_id, 1 AS hits FROM dd JOIN p ON p.owner = dd.owner AND p.token = folder JOIN f ON f.owner = p.owner AND f.token = p.token WHERE length(folder) >= 8 AND freq <= 3 AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = dd.doc_id AND m.project_id = p.project_id))
SELECT owner, doc_id, project_id, hits FROM (FROM m UNION ALL FROM i) QUALIFY row_number() OVER (PARTITION BY owner, doc_id ORDER BY hits DESC, project_id) = 1""")
def doc_project_match(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.expr("p_partkey div 4").alias("owner"), F.split("p_name", " ").alias("words"), F.lower("p_type").alias("kind"))
    projects_ = part.select("owner", F.col("p_partkey").alias("project_id"), F.concat("words", F.array("kind")).alias("tok"))
    lines = table(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("doc_id")).distinct()
    docs = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("owner", "doc_id", "words", F.array("kind").alias("folders"))
    return match.match_documents(docs, projects_)


_REASON = "CASE WHEN event_type = 'error' THEN 'media' WHEN value < 5 THEN 'noise' WHEN user_id % 10 = 0 THEN 'global host' WHEN rn > 1 THEN 'duplicate' ELSE 'promoted' END"
_EV = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(floor(value / 10) AS BIGINT) ORDER BY event_id) AS rn FROM events)"


def _decided(spark: SparkSession, d: str) -> DataFrame:
    e = dedupe.numbered(table(spark, d, "events").withColumn("b", F.floor(F.col("value") / 10)), ["user_id", "event_type", "b"], ["event_id"])
    why = footprint.reason([(F.col("event_type") == "error", "media"), (F.col("value") < 5, "noise"), (F.col("user_id") % 10 == 0, "global host"), (F.col("rn") > 1, "duplicate")], "promoted")
    return e.withColumn("reason", why)


@query(f"WITH {_EV} SELECT {_REASON} AS reason, count(*) AS n FROM e GROUP BY 1")
def decision_reason(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_EV}, r AS (SELECT *, {_REASON} AS reason FROM e) SELECT user_id, count(*) AS discovered, count(*) FILTER (reason = 'promoted') AS promoted, count(*) FILTER (reason = 'promoted' AND event_type = 'purchase') AS matched FROM r GROUP BY 1")
def promote_funnel(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("reason") == "promoted"
    return footprint.funnel(_decided(spark, d), "user_id", {"discovered": F.lit(True), "promoted": good, "matched": good & (F.col("event_type") == "purchase")})


# ---- places

_GAZ = (("the", "en", 45.0, -75.0), ("that", "en", 46.0, -76.0), ("of the", "en", 47.0, -77.0), ("and the", "en", 48.0, -78.0), ("nichts", "de", 49.0, -79.0), ("der", "de", 50.0, -80.0), ("en de", "fr", 51.0, -81.0))
_GRAM = lambda n, tier: f"SELECT id, {tier} AS tier, i - 1 AS k, array_to_string(w[i:i + {n - 1}], ' ') AS place, lang FROM (SELECT *, unnest(range(1, CAST(greatest(len(w) - {n - 2}, 1) AS BIGINT))) AS i FROM d)"


@query(f"""WITH d AS (SELECT doc_id AS id, lang, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents),
g(place, lang, lat, lon) AS (VALUES {', '.join(str(x) for x in _GAZ)}), c AS ({_GRAM(4, 1)} UNION ALL {_GRAM(3, 2)} UNION ALL {_GRAM(2, 3)}
UNION ALL SELECT id, 4, i - 1, s[i], lang FROM (SELECT id, lang, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, lang, list_filter(w, lambda t: length(t) >= 6) AS s FROM d)))
SELECT id, place, tier, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM c JOIN g USING (place, lang) QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, k) = 1""")
def gazetteer_cascade(spark: SparkSession, d: str) -> DataFrame:
    g = spark.createDataFrame(_GAZ, "place string, admin1 string, lat double, lon double")
    names = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), F.lit(None).cast("string").alias("municipality"), F.col("lang").alias("admin1"))
    return spatial.geocode(names, g)


@query("""WITH w AS (SELECT p_partkey, string_split(p_name || ' of ' || lower(p_type), ' ') AS w FROM part) SELECT gram, count(*) AS n FROM (SELECT array_to_string(w[i:i + 1], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) GROUP BY 1""")
def ngrams(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(F.concat_ws(" ", "p_name", F.lit("of"), F.lower("p_type")), " ")
    return table(spark, d, "part").select(F.explode(text.ngrams(w, 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_LON = "(-140.0 + ({} * 7919) % 8700 / 100.0)"
_LAT = "(42.0 + ({} * 104729) % 4100 / 100.0)"
_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_AB = f"a AS (SELECT s_suppkey AS k, {_LON.format('s_suppkey')} AS lon, {_LAT.format('s_suppkey')} AS lat FROM supplier), b AS (SELECT c_custkey AS k, {_LON.format('c_custkey')} AS lon, {_LAT.format('c_custkey')} AS lat FROM customer)"


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from .plans.tables import lonlat

    out = []
    for name, key, to in (("supplier", "s_suppkey", "point_id"), ("customer", "c_custkey", "hit_id")):
        lon, lat = lonlat(F.col(key))
        out.append(table(spark, d, name).select(F.col(key).alias(to), lon.alias("lon"), lat.alias("lat")))
    return tuple(out)


@query(f"WITH {_AB} SELECT a.k AS point_id, b.k AS hit_id FROM a JOIN b ON abs(b.lat - a.lat) <= 50000 / 111320.0 AND abs(b.lon - a.lon) <= 50000 / (111320.0 * greatest(0.1, cos(radians(a.lat))))")
def envelope_hits(spark: SparkSession, d: str) -> DataFrame:
    return spatial.envelope_hits(*_points(spark, d), 50_000)


@query(f"WITH {_AB} SELECT a.k AS point_id, b.k AS hit_id, round({_KM}, 6) AS km FROM a JOIN b ON {_KM} <= 80")
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within(*_points(spark, d), 80)


@query(f"WITH {_AB} SELECT a.k AS point_id, count(*) AS others FROM a JOIN b ON {_KM} <= 120 AND a.k <> b.k GROUP BY 1 HAVING count(*) >= 1")
def nearby_projects(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within(*_points(spark, d), 120).where("point_id <> hit_id").groupBy("point_id").agg(F.count("*").alias("others"))


@query(f"""WITH p AS (SELECT c_nationkey, c_custkey, {_LON.format('c_custkey')} AS lon, {_LAT.format('c_custkey')} AS lat FROM customer),
l AS (SELECT *, lag(lon) OVER w AS x, lag(lat) OVER w AS y FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
SELECT c_nationkey, round(coalesce(sum(CASE WHEN x IS NOT NULL THEN 2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2)))) END), 0), 6) AS km, count(*) AS points FROM l GROUP BY 1""")
def path_length(spark: SparkSession, d: str) -> DataFrame:
    from .plans.tables import lonlat

    lon, lat = lonlat(F.col("c_custkey"))
    return spatial.path_length(table(spark, d, "customer").select("c_nationkey", "c_custkey", lon.alias("lon"), lat.alias("lat")), "c_nationkey", "c_custkey")


# ---- web pages


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("text_md5"))


@query(r"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"#][^"]*)">([^<]*)</a>', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE href END AS target FROM a GROUP BY page_id, href, url""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "pages").select("page_id", "url", F.explode(readers.anchors(F.col("html"))).alias("a"))
    return a.groupBy("page_id", F.col("a.href").alias("href"), "url").agg(F.count("*").alias("n")).select("page_id", "href", "n", readers.absolute(F.col("href"), F.col("url")).alias("target"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


@query(r"""SELECT page_id, lower(regexp_replace(regexp_extract(r, '^[^?]*'), '/+$', '') || regexp_extract(r, '\?.*$')) AS norm FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '^www\.', ''), '#.*$', '') AS r FROM pages)""")
def url_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.norm_url(F.col("url")).alias("norm"))


@query(r"""SELECT regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS site, count(*) AS n, count(*) FILTER (h = 'example.com' OR h LIKE '%.example.com') AS same FROM (SELECT regexp_extract(url, '://([^/?#:]*)', 1) AS h FROM pages) GROUP BY 1""")
def same_site(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(text.apex(F.col("url")).alias("site"), text.same_site(F.col("url"), F.lit("example.com")).alias("s"))
    return p.groupBy("site").agg(F.count("*").alias("n"), F.count_if("s").alias("same"))


@query(r"""SELECT page_id, CASE WHEN n <> '' THEN 'example/' || n ELSE 'web/' || left(sha1(url), 16) END AS key FROM (SELECT page_id, url, regexp_extract(url, '/([0-9]+)\.html', 1) AS n FROM pages)""")
def archive_key(spark: SparkSession, d: str) -> DataFrame:
    n = text.group(F.col("url"), r"/([0-9]+)\.html")
    return table(spark, d, "pages").select("page_id", F.coalesce(F.concat(F.lit("example/"), n), F.concat(F.lit("web/"), F.substring(F.sha1("url"), 1, 16))).alias("key"))


@query()
def html_unescape_full(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(text.unescape(F.col("html"))).alias("md5"))


@query()
def fold_nfkd(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("md5"))


# ---- segmentation


@query(r"SELECT doc_id, i - 1 AS pos, md5(s[i]) AS line_md5, length(s[i]) AS size FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE length(s[i]) > 120")
def segment_lines(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return s.where(F.length("line") > 120).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("line_md5"), F.length("line").cast("long").alias("size"))


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER w, turn + 1) AS stop, turn - lag(turn) OVER w AS gap FROM conversations WHERE role <> 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def next_boundary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role <> 'assistant'").select("conv_id", "turn")
    return segment.next_boundary(c, "conv_id", "turn", F.col("turn") + 1)


@query("SELECT conv_id, turn, md5(last_value(CASE WHEN role <> 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn)) AS heading FROM conversations")
def carry_heading(spark: SparkSession, d: str) -> DataFrame:
    c = segment.carry_heading(table(spark, d, "conversations"), "conv_id", "turn", F.when(F.col("role") != "assistant", F.col("text")))
    return c.select("conv_id", "turn", F.md5("heading").alias("heading"))


@query("SELECT conv_id, turn, 'c' || conv_id || '-doc-' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') AS seq_id FROM conversations")
def sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return segment.sequence_ids(c, F.concat(F.lit("c"), "conv_id", F.lit("-doc")), "conv_id", "turn")


# ---- link audits

_KINDS = ["click", "error", "purchase", "signup", "view"]
_CASES = ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS)


@query(f"WITH r AS (SELECT CAST(user_id % 5 AS VARCHAR) AS source, {_CASES}, count(*) AS total FROM events GROUP BY 1 UNION ALL SELECT 'total', {_CASES}, count(*) FROM events) SELECT *, error + signup AS broken, round((error + signup) / total, 6) AS share FROM r")
def link_rollup(spark: SparkSession, d: str) -> DataFrame:
    return links.rollup(table(spark, d, "events").withColumn("source", F.col("user_id") % 5), "source", "event_type", _KINDS, ["error", "signup"])


@query("SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 30 THEN 'index_verified' END AS verdict FROM events")
def host_cap(spark: SparkSession, d: str) -> DataFrame:
    return links.host_cap(table(spark, d, "events"), "user_id", "event_id", 30).select("event_id", "user_id", "verdict")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5")
def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.first_per_group(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], 5, ["event_id"])


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn, min(event_id) OVER (PARTITION BY user_id) AS place FROM events")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.round_robin(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 10 = 0")
def canary_nth(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.every_nth(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 10)


@query("SELECT event_id, coalesce(count(*) OVER w = 2 AND sum(CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END) OVER w = 0, false) AS dead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)")
def dead_hosts(spark: SparkSession, d: str) -> DataFrame:
    return links.dead_hosts(table(spark, d, "events"), "user_id", "event_id", F.col("event_type").isin("view", "click"), 2).select("event_id", F.coalesce("dead", F.lit(False)).alias("dead"))


@query("SELECT round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 9) AS share, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.02 AS alarm FROM events")
def link_health(spark: SparkSession, d: str) -> DataFrame:
    return links.health(table(spark, d, "events"), F.col("event_type") == "error").withColumn("share", F.round("share", 9))


# ---- entities


@query("""WITH r AS (SELECT c_mktsegment || ' Corp' AS variant, lower(c_mktsegment) AS key, c_custkey AS ord, 1 AS projects, count(o_orderkey) AS docs, coalesce(sum(o_totalprice), 0) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)
SELECT key, CAST(sum(projects) AS BIGINT) AS projects, CAST(sum(docs) AS BIGINT) AS docs, round(sum(value), 2) AS value, max(variant) AS name, 1 AS variants, round(3 * sum(projects) + 0.05 * sum(docs) + sum(value) / 1e8, 1) AS score FROM r GROUP BY 1""")
def proponent_footprint(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("docs"), F.sum("o_totalprice").alias("value"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    variant = F.concat("c_mktsegment", F.lit(" Corp"))
    rows = c.select(variant.alias("variant"), text.norm_company(variant).alias("key"), F.col("c_custkey").alias("ord"), F.lit(1).alias("projects"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("value", F.lit(0.0)).alias("value"))
    return footprint.footprint(rows).withColumn("value", F.round("value", 2))


@query("""WITH r AS (SELECT p_partkey, p_name AS key FROM part), c AS (SELECT p_partkey, CASE WHEN key = 'red gear' THEN 'RG' WHEN ' ' || key || ' ' LIKE '% gizmo %' THEN 'GIZMO' WHEN ' ' || key || ' ' LIKE '% red %' THEN 'RED' ELSE key END AS canonical FROM r) SELECT canonical, count(*) AS n FROM c GROUP BY 1""")
def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([("gizmo", "GIZMO", 1), ("red", "RED", 2), ("red gear", "RG", 3)], "alias string, canonical string, ord int")
    return footprint.apply_aliases(table(spark, d, "part").select(F.col("p_name").alias("key")), "key", a).groupBy("canonical").agg(F.count("*").alias("n"))


# Names around which public bodies and companies turn, for the customers.
_BODIES = ("The City of {}", "{} University", "{} Hospital Power Inc", "{} First Nation", "{} Corp Commission", "{} Mining Agency", "{} Ltd", "Crown {} Resources", "Township Energy {}", "{} Township Inc", "Parks Canada {}", "Cityscape {}")


@query(f"""WITH n AS (SELECT c_custkey, replace([{', '.join(f"'{b}'" for b in _BODIES)}][c_custkey % {len(_BODIES)} + 1], '{{}}', c_name) AS n FROM customer)
SELECT c_custkey, regexp_matches(n, '(?i)^\\s*(the\\s+)?(department|ministry|city|town|village|municipality|county|region|district|province|government|crown)\\b')
  OR (regexp_matches(n, '(?i)\\b(parks canada|township|first nation|nation|agency|university|hospital|commission)\\b') AND NOT regexp_matches(n, '(?i)\\b(power|energy|mines?|mining|resources)\\b')) AS public FROM n""")
def public_body_filter(spark: SparkSession, d: str) -> DataFrame:
    pattern = F.element_at(F.array(*map(F.lit, _BODIES)), (F.col("c_custkey") % len(_BODIES) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", footprint.is_public(F.replace(pattern, F.lit("{}"), F.col("c_name"))).alias("public"))


@query("""WITH e AS (SELECT user_id, event_id, value, CASE WHEN event_type IN ('view','click') THEN 'approval' ELSE 'amendment' END AS kind FROM events), k AS (SELECT user_id, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, count(*) AS n FROM e GROUP BY 1)
SELECT event_id, kinds IN ('approval','amendment,approval') AND n > 1 AS relabel FROM e JOIN k USING (user_id)""")
def section_relabel(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("view", "click"), "approval").otherwise("amendment").alias("kind"))
    return footprint.section_relabel(e, ["user_id"], "kind").select("event_id", "relabel")


# ---- full text

_TERMS = "SELECT doc_id AS doc, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM documents"
_IX = f"w AS ({_TERMS}), ix AS (SELECT term, doc, count(*) AS tf, any_value(doc_len) AS doc_len FROM (SELECT doc, len(w) AS doc_len, unnest(w) AS term FROM w) GROUP BY 1, 2)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return search.index(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(f"WITH {_IX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM ix GROUP BY 1")
def fts_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_IX} SELECT doc FROM ix WHERE term IN ('the', 'license') GROUP BY 1 HAVING count(*) = 2")
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    return search.match_all(_index(spark, d), ["the", "license"])


@query(f"""WITH {_IX}, l AS (SELECT doc, any_value(doc_len) AS doc_len FROM ix GROUP BY 1), c AS (SELECT count(*) AS n, avg(doc_len) AS a FROM l), h AS (SELECT * FROM ix WHERE term IN ('license', 'apache', 'that')), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / a))), 6) AS score FROM h JOIN f USING (term), c GROUP BY 1""")
def fts_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_texts(table(spark, d, "documents"), "doc_id", F.col("text"), ["license", "apache", "that"])


@query(f"""WITH {_IX}, l AS (SELECT doc, any_value(doc_len) AS doc_len FROM ix GROUP BY 1), c AS (SELECT count(*) AS n, avg(doc_len) AS a FROM l), h AS (SELECT * FROM ix WHERE term IN ('notice', 'the')), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / a))), 6) AS score FROM h JOIN f USING (term), c GROUP BY 1""")
def fts_bm25_index(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_index(spark, d), ["notice", "the"])


_FIELDS = {"source": 10.0, "lang": 5.0, "text": 1.0}
_TOK = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""WITH w AS (SELECT doc_id, {', '.join(f"{_TOK.format(c)} AS f{i}" for i, c in enumerate(_FIELDS))} FROM documents), l AS (SELECT doc_id, len(f0) + len(f1) + len(f2) AS doc_len FROM w), c AS (SELECT count(*) AS n, avg(doc_len) AS a FROM l),
h AS (SELECT doc_id, unnest(f0) AS term, 10.0 AS k FROM w UNION ALL SELECT doc_id, unnest(f1), 5.0 FROM w UNION ALL SELECT doc_id, unnest(f2), 1.0 FROM w),
x AS (SELECT doc_id, term, sum(k) AS f FROM h WHERE term IN ('license', 'apache', 'src3', 'en') GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM x GROUP BY 1),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * doc_len / a))) AS score FROM x JOIN d USING (term) JOIN l USING (doc_id), c GROUP BY 1)
SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def fts_fields_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents by three weighted fields, from the block index."""
    wanted = ["license", "apache", "src3", "en"]
    ix = blocks.build(table(spark, d, "documents"), "doc_id", _FIELDS, only=wanted)
    return blocks.top(ix, wanted)[0].withColumnRenamed("id", "doc_id")


@query(f"WITH {_IX} SELECT term, count(*) AS df, CAST(count(DISTINCT doc) AS BIGINT) AS docs, count(DISTINCT (SELECT count(*) FROM documents x WHERE x.doc_id < doc) // 1024) AS blocks FROM ix GROUP BY 1")
def fts_blocks(spark: SparkSession, d: str) -> DataFrame:
    """How many postings and blocks each term of the whole index has."""
    ix = blocks.build(table(spark, d, "documents"), "doc_id", {"text": 1.0})
    return ix.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("n").alias("docs"), F.count("*").alias("blocks"))


@query()
def fts_porter(spark: SparkSession, d: str) -> DataFrame:
    # each document has each of its stems once, and ids are distinct
    w = table(spark, d, "documents").select(F.explode(search.stems(F.col("text"))).alias("stem"))
    return w.groupBy("stem").agg(F.count("*").alias("df"))


@query("SELECT doc_id, substr(text, greatest(position('license' IN lower(text)) - 30, 1), 60) AS snippet FROM documents WHERE contains(lower(text), 'license')")
def fts_snippet(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return t.select("doc_id", search.snippet(F.col("text"), "license").alias("snippet"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 're') OR contains(lower(p_name), ' re') ORDER BY p_name, p_partkey LIMIT 30")
def typeahead(spark: SparkSession, d: str) -> DataFrame:
    low = text.fold_latin(F.col("p_name"))
    return table(spark, d, "part").where(low.startswith("re") | low.contains(" re")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(30)


# ---- grids and graphs


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    areas = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("area"))
    cells = areas.select("area", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("col"))
    n = table(spark, d, "nation")
    layers = n.select(F.col("n_regionkey").cast("long").alias("area"), (F.col("n_nationkey") % 2).alias("layer"), F.lit(0).alias("ring"), ((F.col("n_nationkey") * 7) % 20).alias("row"), ((F.col("n_nationkey") * 11) % 20).alias("col"), F.lit(3.0).alias("radius"), (F.col("n_nationkey") % 2 * 4.0 + 2.0).alias("value"))
    return cells, layers


@query("""WITH c AS (SELECT r_regionkey AS area, r AS "row", k AS col FROM region, range(20) a(r), range(20) b(k)), l AS (SELECT n_regionkey AS area, n_nationkey % 2 AS layer, (n_nationkey * 7) % 20 AS r0, (n_nationkey * 11) % 20 AS c0, n_nationkey % 2 * 4.0 + 2.0 AS value FROM nation),
h AS (SELECT DISTINCT c.area, layer, "row", col, value FROM c JOIN l ON c.area = l.area AND pow("row" - r0, 2) + pow(col - c0, 2) <= 9), s AS (SELECT area, "row", col, sum(value) AS v FROM h GROUP BY 1, 2, 3), t AS (SELECT c.area, c."row", c.col, 1.0 + coalesce(v, 0) AS x FROM c LEFT JOIN s USING (area, "row", col))
SELECT CAST(area AS BIGINT) AS area, "row", col, CAST(x - min(x) OVER (PARTITION BY area) + 1 AS DOUBLE) AS cost FROM t""")
def cost_surface(spark: SparkSession, d: str) -> DataFrame:
    return route.burn(*_grid(spark, d))


@query()
def least_cost_path(spark: SparkSession, d: str) -> DataFrame:
    return _routes(spark, d, 1)


@query()
def route_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return route.route_summary(_routes(spark, d, 3))


def _routes(spark: SparkSession, d: str, k: int) -> DataFrame:
    ends = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("area"), F.lit(0).alias("r0"), F.lit(0).alias("c0"), F.lit(19).alias("r1"), F.lit(19).alias("c1"))
    return route.routes(route.burn(*_grid(spark, d)), ends, k)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + k) % 25 AS t, (n_nationkey + k) % 5 AS p, (n_nationkey + k) % 3 > 0 AS strong FROM nation, range(1, 4) x(k)),
w(url, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT t, depth + 1 FROM w JOIN e ON s = url WHERE depth < 3 AND (depth = 0 OR strong)) SELECT CAST(url AS BIGINT) AS url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    e = n.select("src", ((F.col("src") * 3 + F.col("k")) % 25).alias("dst"), ((F.col("src") + F.col("k")) % 5).alias("priority"), ((F.col("src") + F.col("k")) % 3 > 0).alias("strong"))
    seeds = table(spark, d, "nation").where("n_nationkey = 0").select(F.lit("s").alias("site"), F.col("n_nationkey").cast("long").alias("url"))
    return crawl.frontier(seeds, e).select("url", "depth")


# ---- checks


@query("""SELECT 'fail' AS level, 'type' AS "check", count(*) AS n, min(CAST(p_partkey AS VARCHAR)) AS first_item FROM part WHERE p_type = 'PROMO' UNION ALL SELECT 'warn', 'size', count(*), min(CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size > 45""")
def quality_violations(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return quality.summary(quality.violations(p, F.col("p_partkey"), [("fail", "type", F.col("p_type") == "PROMO", F.col("p_type")), ("warn", "size", F.col("p_size") > 45, F.col("p_size"))]))


@query("""WITH k(label, variant) AS (VALUES ('exact', 'red gear'), ('start', 'red'), ('inside', 'gear'), ('none', 'zzz')) SELECT label, coalesce(max(CASE WHEN p_name IS NULL THEN 0 WHEN p_name = variant THEN 3 WHEN starts_with(p_name, variant) THEN 2 ELSE 1 END), 0) AS level FROM k LEFT JOIN part ON contains(lower(p_name), variant) GROUP BY 1""")
def known_ladder(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("exact", "red gear"), ("start", "red"), ("inside", "gear"), ("none", "zzz")], "label string, variant string")
    return quality.known_ladder(table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), known)


@query("SELECT (SELECT count(*) FROM labels) AS index_rows, (SELECT count(DISTINCT doc_id) FROM labels) AS index_keys, (SELECT count(*) FROM documents) AS feature_rows, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_index, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_features")
def index_parity(spark: SparkSession, d: str) -> DataFrame:
    return quality.parity(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@query("SELECT p_type, round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END), 9) AS share, count(*) AS n FROM part GROUP BY 1")
def share_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.round(F.avg((F.col("p_size") > 25).cast("double")), 9).alias("share"), F.count("*").alias("n"))


@query("SELECT c_custkey, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(45.4 - " + _LAT.format("c_custkey") + ") / 2), 2) + cos(radians(" + _LAT.format("c_custkey") + ")) * cos(radians(45.4)) * pow(sin(radians(-75.7 - " + _LON.format("c_custkey") + ") / 2), 2)))), 6) AS km FROM customer")
def distance_to_capital(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d)
    return p.select(F.col("ord").alias("c_custkey"), F.round(geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(-75.7), F.lit(45.4)), 6).alias("km"))


# ---- archives and pages


@query(r"""WITH u AS (SELECT page_id, url || CASE page_id % 4 WHEN 1 THEN '/a%20b%2Bc.pdf' WHEN 2 THEN '/%C3%A9t%C3%A9+1.doc' ELSE '' END AS url FROM pages), b AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '[?#].*$', ''), '[^/]*$') AS b FROM u),
n AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN coalesce(nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), ''), 'file') || '.pdf' WHEN NOT contains(b, '.') THEN left(sha1(url), 16) || '.html' ELSE url_decode(b) END AS n FROM b)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'qc' ELSE 'on' END || '/p' || (page_id % 5) || '/' || left(regexp_replace(regexp_replace(n, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 120) AS key FROM n""")
def object_key(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    url = F.concat("url", F.when(k % 4 == 1, "/a%20b%2Bc.pdf").when(k % 4 == 2, "/%C3%A9t%C3%A9+1.doc").otherwise(""))
    return table(spark, d, "pages").select("page_id", web.object_key(F.when(k % 3 == 0, "qc").otherwise("on"), F.concat(F.lit("p"), k % 5), url).alias("key"))


@query("""WITH o AS (SELECT 'k' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.bin' END AS path, CAST(p_size AS BIGINT) AS bytes FROM part UNION ALL SELECT 'k' || p_partkey || '.doc', 1 FROM part WHERE p_partkey % 4 = 0),
t AS (SELECT 'u' || c_custkey AS url, 'k' || c_custkey AS base FROM customer), x(ext, k) AS (VALUES ('.pdf', 0), ('.html', 1), ('.docx', 2), ('.doc', 3), ('.zip', 4), ('.xlsx', 5), ('.xls', 6), ('.bin', 7))
SELECT url, path AS key, bytes FROM t CROSS JOIN x JOIN o ON o.path = base || ext QUALIFY row_number() OVER (PARTITION BY url ORDER BY k) = 1""")
def bucket_reconcile(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey") % 3
    one = p.select(F.concat(F.lit("k"), "p_partkey", F.when(k == 0, ".pdf").when(k == 1, ".html").otherwise(".bin")).alias("path"), F.col("p_size").cast("long").alias("bytes"))
    two = p.where("p_partkey % 4 = 0").select(F.concat(F.lit("k"), "p_partkey", F.lit(".doc")).alias("path"), F.lit(1).cast("long").alias("bytes"))
    return archive.reconcile(table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("url"), F.concat(F.lit("k"), "c_custkey").alias("key_base")), one.unionAll(two))


@query("""WITH f AS (SELECT p_brand AS project, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS t, min(p_partkey) AS k FROM part GROUP BY 1, 2),
l AS (SELECT 'Brand#' || (s_suppkey % 25 + 1) AS project, CASE s_suppkey % 2 WHEN 0 THEN 'Red-Gear' ELSE 'BLUE bolt!' END AS title, 'u' || s_suppkey AS url FROM supplier)
SELECT url, 'f' || k AS path FROM l JOIN f ON l.project = f.project AND regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') = t""")
def title_join(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").select(F.col("p_brand").alias("project"), F.col("p_name").alias("title"), F.concat(F.lit("f"), "p_partkey").alias("path"), F.col("p_partkey").alias("ord"))
    s = F.col("s_suppkey")
    l_ = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), s % 25 + 1).alias("project"), F.when(s % 2 == 0, "Red-Gear").otherwise("BLUE bolt!").alias("title"), F.concat(F.lit("u"), s).alias("url"))
    return archive.by_title(l_, f)


@query(r"""WITH n AS (SELECT page_id, url, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$')) AS n FROM pages), f AS (SELECT n, max(page_id) AS k FROM n GROUP BY 1) SELECT page_id, k AS last_page FROM n JOIN f USING (n) WHERE n <> ''""")
def basename_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    hit = archive.by_basename(p.select("url").distinct(), p.select(F.col("url").alias("path"), F.col("page_id").alias("ord")))
    last = hit.join(p.select(F.col("url").alias("path"), "page_id").groupBy("path").agg(F.max("page_id").alias("last_page")), "path").select("url", "last_page")
    return p.join(last, "url").select("page_id", "last_page")


@query(r"""SELECT page_id, CAST(3 * len(regexp_extract_all(url, '(?i)project|permit|impact')) + len(regexp_extract_all(url, '(?i)wind|station')) AS BIGINT) AS priority FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '/Project-impact' WHEN 1 THEN url || '/wind-station' WHEN 2 THEN url || '/permit' ELSE url END AS url FROM pages)""")
def crawl_priority(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    u = F.concat("url", F.when(k == 0, "/Project-impact").when(k == 1, "/wind-station").when(k == 2, "/permit").otherwise(""))
    return table(spark, d, "pages").select("page_id", web.priority(u, F.lit("")).cast("long").alias("priority"))


@query("""WITH a AS (SELECT user_id, arg_min(event_type, event_id) AS v FROM events GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY 1 HAVING user_id % 3 > 0)
SELECT a.user_id AS url, CASE WHEN a.v = 'error' THEN coalesce(b.v, a.v) ELSE a.v END AS verdict, CASE WHEN a.v = 'error' THEN coalesce(b.v = a.v, false) END AS confirmed FROM a LEFT JOIN b USING (user_id)""")
def confirm_pass(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("url")).agg(F.min_by("event_type", "event_id").alias("verdict"), F.max_by("event_type", "event_id").alias("last"))
    return archive.rechecked(e.select("url", "verdict"), e.where("url % 3 > 0").select("url", F.col("last").alias("verdict")), F.col("verdict") == "error")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id < 500)")
def resume_unseen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return archive.unseen(e.select("event_id", "user_id"), e.where("event_type = 'signup' and event_id < 500").select("user_id"), "user_id").select("event_id")


from . import more_queries, space_queries  # noqa: E402,F401  register their own
