"""One query for each operator of this package, over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, divergence, minhash, mips, mixing, passages, pieces, quality, sharding, tokens, turns, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_spans(table(spark, sf_dir, "documents")).drop("text_key")


def op4_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips.top_products(table(spark, sf_dir, "embeddings"))


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op6_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op7_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_piece_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.segmentations(table(spark, sf_dir, "documents"))
    places = lambda x: F.struct(x.n_pieces.alias("n_pieces"), x.ids_crc32.alias("ids_crc32"), F.round(x.log_prob, 6).alias("log_prob"), F.round(x.value, 6).alias("value"), F.round(x.log_inclusion, 6).alias("log_inclusion"), x.decoded.alias("decoded"), x.ids.alias("ids"))
    return found.withColumn("samples", F.transform("samples", places))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"))


def op13_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


ORACLE: dict[str, str] = {}

#: Words of a text as in op2, from the column ``text``.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

ORACLE["op2_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 75 * (len(a.sh) + len(b.sh) - n)),
bi AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, bi.y FROM r JOIN bi ON bi.x = r.b)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = s.doc_id"""

ORACLE["op3_suffix_array_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(ws) - 49)) AS s, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1:s + 50], ' ')) AS k FROM g),
o AS (SELECT k, min(doc_id) AS f FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT h.doc_id, s, f, f < h.doc_id AS later FROM h JOIN o USING (k)),
m AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id, later ORDER BY s) + 50 THEN 0 ELSE 1 END AS head FROM r),
n AS (SELECT *, sum(head) OVER (PARTITION BY doc_id, later ORDER BY s) AS i FROM m)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) + 50 - min(s) AS BIGINT) AS n_words, min(f) AS first_doc_id, later AS repeat
FROM n GROUP BY doc_id, later, i"""

ORACLE["op4_ball_tree_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

_TERM = "regexp_matches(t, '(^|[^a-z0-9]){}([^a-z0-9]|$)')"
_WEIGHT = " + ".join(f"CASE WHEN {_TERM.format(k)} THEN {w} ELSE 0 END" for k, w in sorted(urls.WEIGHTS.items()))
_RULES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for _, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
)
_VERDICTS = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in urls.RULES)
ORACLE["op7_url_vocabulary"] = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(split_part(substr(url, instr(url, '://') + 3), '?', 1), '#', 1) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(split_part(r, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(r, '/') THEN substr(r, instr(r, '/')) ELSE '' END AS path FROM u),
t AS (SELECT *, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, CASE {_RULES} END AS rule FROM s),
w AS (SELECT *, CAST({_WEIGHT} AS BIGINT) AS weight FROM t)
SELECT page_id, host, path, rule, weight, CASE rule {_VERDICTS} ELSE CASE WHEN weight >= {urls.REJECT} THEN 'block' ELSE 'allow' END END AS verdict FROM w"""

ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND f < page_id THEN f END AS refers_to FROM m"""

ORACLE["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY 1),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""

#: crc32 of the ASCII text k, bit by bit.
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_transform(range(1, length(k) + 1), lambda i: unicode(substr(k, i, 1))::UBIGINT),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)),
      lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END), 4294967295::UBIGINT))"""


def _then(state: str, cost: str, edit: str, when: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': ({state}).c + {cost}, 'a': ({state}).a || '{edit}'}} END"


def _edits(state: str, role: str) -> str:
    """A turn x that is kept or gets the role, behind a state."""
    given = [_then(state, "2 + x.t", "R", "NOT x.m")] if role in "ua" else []
    return ", ".join([_then(state, "x.t", "K", f"NOT x.m AND x.r = '{role}'"), *given])


#: From the least (cost, audit) of each state, s[1] start, s[2] after s, s[3] after u,
#: s[4] after a, to those behind one more turn and the turns inserted after it.
_TURN = f"""list_transform([[{_then("s[1]", "3", "D")},
    list_min([{_then("s[2]", "3", "D")}, {_edits("s[1]", "s")}]),
    list_min([{_then("s[3]", "3", "D")}, {_edits("s[1]", "u")}, {_edits("s[2]", "u")}, {_edits("s[4]", "u")}]),
    list_min([{_then("s[4]", "3", "D")}, {_edits("s[3]", "a")}])]],
  lambda e: list_transform([list_min([e[3], {_then("e[1]", "2", "I")}, {_then("e[2]", "2", "I")}, {_then("e[4]", "2", "I")}])],
    lambda u: [e[1], e[2], u, list_min([e[4], {_then("u", "2", "I")}])])[1])[1]"""

ORACLE["op12_conversation_repair"] = rf"""
WITH k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS way FROM k),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
    CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE way WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
f AS (SELECT *, t = '' AS b, t <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS d,
    lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM n),
g AS (SELECT *, NOT b AND NOT d AND t NOT SIMILAR TO '(.|\n)*[.!?]' AS c FROM f),
v AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (b) AS blank, count(*) FILTER (d) AS duplicate,
    count(*) FILTER (c) AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'m': b OR d, 't': c::BIGINT, 'r': left(role, 1), 'role': role, 'text': text}} ORDER BY n) AS xs FROM g GROUP BY conv_id),
s AS (SELECT *, list_reduce(xs, lambda s, x: {_TURN}, [{{'c': 0::BIGINT, 'a': ''}}, NULL, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 4::BIGINT, 'a': 'II'}}]) AS s FROM v),
w AS (SELECT * EXCLUDE (s), list_min([s[1], s[4]]) AS w FROM s),
o AS (SELECT *, list_reduce(list_filter(string_split(w.a, ''), lambda e: e <> ''), lambda q, e: list_transform([CASE WHEN e = 'K' THEN xs[q.i].role WHEN q.s = 2 THEN 'assistant' ELSE 'user' END],
    lambda r: {{'i': q.i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, 's': CASE WHEN e = 'D' THEN q.s ELSE CASE left(r, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END,
      'o': CASE WHEN e = 'D' THEN q.o ELSE list_append(q.o, r || ':' || CASE WHEN e = 'I' THEN '' ELSE xs[q.i].text END) END}})[1],
    {{'i': 1::BIGINT, 's': 0, 'o': []::VARCHAR[]}}).o AS o FROM w),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(o, chr(10)), '')) AS repaired_sha256
FROM a LEFT JOIN o ON a.conv_id IS NOT DISTINCT FROM o.conv_id"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
