import json
import math
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import dedupe, enrich, footprint, links, match, merge, predict, quality, route, segment, spatial
from dossier.plans import projects
from dossier.sources import readers, writers
from dossier.streaming import lanes


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_manifest_merge_prefers_keys_and_keeps_dates(spark):
    schema = "url string, key string, fetched_at string, fails int, doc_date string"
    a = spark.createDataFrame([("u", "k", "2020", 1, None), ("v", None, "2020", 2, "d"), ("w", "a", "1", 0, None)], schema)
    b = spark.createDataFrame([("u", None, "2021", 3, "x"), ("v", None, "2022", 1, None), ("z", "q", "5", 0, "y")], schema)
    assert rows(merge.merge_manifests(a, b), "url", "key", "fails", "doc_date") == [("u", "k", 3, "x"), ("v", None, 2, "d"), ("w", "a", 0, None), ("z", "q", 0, "y")]
    assert rows(merge.merge_manifests(a, a), "url", "key", "fetched_at", "fails", "doc_date") == rows(a, "url", "key", "fetched_at", "fails", "doc_date")


def test_register_ties_and_asymmetry(spark):
    schema = "project string, project_id string, project_archetype string, jurisdiction string, discipline string, discipline_secondary array<string>, measure_type string, timing string, measure_text string, source_doc string, ord long"
    pool = spark.createDataFrame(
        [
            ("A", "1", "wind", "BC", "noise", [], "m", "t2", "first", "d1", 1),
            ("A", "2", "wind", "BC", "noise", [], "m", "t1", "second", "d2", 2),
            ("B", None, "wind", "ON", "other", ["noise"], "m", None, "third", "d3", 3),
            ("C", "3", "wind", "ON", "other", ["noise"], "other", None, "admin", "d4", 4),
            ("D", "4", "mining", "ON", "noise", None, "m", None, "weak", "d5", 5),
        ],
        schema,
    )
    out = {(r.discipline, r.measure_type): r for r in predict.register(pool, "wind", ["noise"]).collect()}
    assert set(out) == {("noise", "m"), ("other", "m")}
    r = out["noise", "m"]
    assert (r.precedent_projects, r.frequency, r.typical_timing, r.sample_condition) == (1, "1/4 comparable projects", "t2", "first")
    assert rows(predict.register(pool, "wind", ["noise"], strong=False), "sample_condition") == [("weak",)]
    shuffled = predict.register(pool.repartition(7), "wind", ["noise"])
    assert [r.discipline for r in shuffled.collect()] == ["noise", "other"]


def test_best_match_anchors_and_floor(spark):
    ext = spark.createDataFrame([(1, ["west", "detour"], ["acme"], -75.0, 45.0), (2, ["falls", "ranney"], ["acme"], -75.0, 45.0), (3, [], [], None, None)], "ext_id long, tok array<string>, prop_tok array<string>, lon double, lat double")
    ours = spark.createDataFrame([(1, 1, ["west"], [], None, None), (2, 2, ["detour", "west"], [], None, None), (3, 3, ["falls", "healey"], ["acme"], -75.0, 45.0)], "our_id long, ord long, tok array<string>, prop_tok array<string>, lon double, lat double")
    got = {r.ext_id: r for r in match.best_match(ext, ours).collect()}
    assert (got[1].our_id, got[1].verdict) == (2, "matched")
    assert got[2].our_id == 3 and got[2].verdict != "matched"  # same owner, same place, other name
    assert (got[3].our_id, got[3].verdict) == (None, "gap")


def test_disambiguation(spark):
    docs = spark.createDataFrame([(1, "c", "Plan", "x", "one"), (2, "c", "Plan", "x", "two"), (3, "c", "Map", "x", None), (4, "c", "Map", "x", "m"), (5, "c", "Solo", "x", None), (6, "c", "Plan", "y", None)], "ord int, cat string, title string, date string, tag string")
    got = dict(rows(dedupe.disambiguate(docs, ["cat"], "title", "date", "ord", [F.col("tag")]), "ord", "new_title"))
    assert got == {1: "Plan (one)", 2: "Plan (two)", 3: "Map (1 of 2)", 4: "Map (2 of 2)", 5: "Solo", 6: "Plan"}


def test_best_title(spark):
    docs = spark.createDataFrame([("u", "Download", 1, ""), ("u", "decision", 2, "c"), ("u", "Minister's Decision", 3, "d")], "url string, title string, ord int, category string")
    assert rows(dedupe.merge_by_url(docs, fields=["category"]), "url", "ord", "title", "category") == [("u", 1, "Minister's Decision", "c")]
    again = dedupe.merge_by_url(dedupe.merge_by_url(docs, fields=["category"]), fields=["category"])
    assert rows(again, "title") == [("Minister's Decision",)]


def test_conditions_quality(spark):
    schema = "condition_id string, project string, jurisdiction string, discipline string, discipline_secondary array<string>, measure_type string, timing string, measure_text string, ord int"
    c = spark.createDataFrame([("a", "p", "j", "light", ["light"], "monitoring_followup", None, "Same  text", 1), ("b", "p", "j", "nope", ["x"], "avoidance", "whenever", "same text!", 2)], schema)
    got = rows(quality.conditions(c), "level", "check", "item")
    assert got == [("fail", "discipline", "b"), ("fail", "primary_in_secondary", "a"), ("fail", "secondary", "b"), ("fail", "timing", "b"), ("warn", "repeated_text", "b")]


def test_marked_conditions(spark):
    text = "Intro. Conditions 2 Fish and habitat 2.1 The proponent shall protect all of the fish in the river at all times. 2.2 The proponent shall monitor the fish that live in the river. 2.3 Short. Issuance 2.4 The proponent shall not see this one at all, ever."
    got = rows(segment.marked_conditions(spark.createDataFrame([(1, text)], "doc_id long, text string")), "condition_no", "section_title")
    assert got == [("2.1", "Fish and habitat"), ("2.2", "Fish and habitat")]


def test_routes_avoid_cost_and_alternatives_differ(spark):
    cells = [(1, r, c, 50.0 if c == 2 and r < 4 else 1.0) for r in range(5) for c in range(5)]
    costs = spark.createDataFrame(cells, "area long, row int, col int, cost double")
    ends = spark.createDataFrame([(1, 0, 0, 0, 4)], "area long, r0 int, c0 int, r1 int, c1 int")
    path = [(r.row, r.col) for r in route.routes(costs, ends, 1).orderBy("seq").collect()]
    assert path[0] == (0, 0) and path[-1] == (0, 4) and (4, 2) in path


def test_polygons(spark):
    p = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0)], "lon double, lat double")
    assert rows(spatial.in_polygon(p, {"box": [(0, 0), (1, 0), (1, 1), (0, 1)]}).where("polygon is not null"), "lon") == [(0.5,)]


def test_readers_tolerate_what_is_missing_or_broken(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [-75, 45]}, "properties": {"name": "x"}}, {"geometry": {"type": "MultiPoint", "coordinates": [[-76, 46], [1, 2]]}, "properties": {"name": "y"}}, {"geometry": None, "properties": {"name": "z"}}]}))
    got = rows(readers.geojson(spark, str(tmp_path / "a.geojson"), "name:string"), "name", "lon", "lat")
    assert got == [("x", -75.0, 45.0), ("y", -76.0, 46.0), ("z", None, None)]
    assert readers.geojson(spark, str(tmp_path / "none.geojson"), "name:string").count() == 0
    (tmp_path / "bad.json").write_text("Service unavailable")
    assert rows(readers.json_rows(spark, str(tmp_path / "bad.json"), "name string"), "name") == []
    (tmp_path / "m.json").write_text(json.dumps({"http://a": {"key": "k", "fails": 1}}))
    assert rows(readers.url_map(spark, str(tmp_path / "m.json")), "url", "key", "fails") == [("http://a", "k", 1)]


def test_html(spark):
    html = "<table><tr><th>h</th></tr><tr><td>a&nbsp;<b>b</b></td><td>c</td></tr><tr><td>d<td>e</table><a href='/x'>X <i>y</i></a><a href='mailto:q'>m</a>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(readers.table_rows(F.col("h"), 2).alias("x")).first().x == [["a b", "c"], ["d", "e"]]
    assert [tuple(a) for a in df.select(readers.anchors(F.col("h")).alias("x")).first().x] == [("/x", "X y")]


def test_writers(spark, tmp_path):
    f = spark.createDataFrame([(2, -75.0, 45.0, "b", None), (1, None, None, "a", "t")], "ord long, lon double, lat double, name string, type string")
    writers.feature_collection(f, str(tmp_path / "out"))
    data = json.loads((tmp_path / "out").read_text())  # one file, joined at commit
    assert [x["properties"]["name"] for x in data["features"]] == ["a", "b"]
    assert data["features"][1]["geometry"]["coordinates"] == [-75.0, 45.0]
    assert writers.if_changed(f, str(tmp_path / "t")) and not writers.if_changed(f, str(tmp_path / "t"))


def test_project_table(spark):
    blocks = [spark.createDataFrame([(1, "West Mine", "Nova Scotia (NSECC)", None, "", None, None, None, "")], "ord long, name string, jurisdiction string, type string, description string, lon double, lat double, municipality string, proponent string")] * 1
    blocks.append(blocks[0].withColumn("ord", F.lit(2).cast("long")))
    gaz = spark.createDataFrame([("west mine", "Nova Scotia (NSECC)", 45.0, -63.0)], "place string, admin1 string, lat double, lon double")
    got = projects.assemble(blocks, gaz).orderBy("ord").collect()
    assert [g.category for g in got] == ["mining", "mining"] and got[0].lon == -63.0
    assert got[1].id == got[0].id + "x"


def test_manifest_lane_resumes(spark, tmp_path):
    schema = "url string, ok boolean, ts timestamp, key string, doc_date string"

    def land(i, data):
        spark.createDataFrame(data, "url string, ok boolean, ts string, key string, doc_date string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run():
        lanes.manifest_lane(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "m"), str(tmp_path / "ck")).awaitTermination()

    land(0, [("u", False, "2024-01-01", None, None), ("v", True, "2024-01-01", "k", "d")])
    run()
    land(1, [("u", False, "2024-01-02", None, None), ("v", False, "2024-01-03", None, None)])
    run()
    run()
    assert rows(lanes.latest(spark, str(tmp_path / "m"))[1], "url", "key", "fails") == [("u", None, 2), ("v", "k", 1)]


def test_rollup_and_public_bodies(spark):
    p = spark.createDataFrame([("a", "ok"), ("a", "error"), ("b", "ok")], "source string, verdict string")
    assert rows(links.rollup(p, "source", "verdict", ["ok", "error"], ["error"]), "source", "total", "broken") == [("a", 2, 1), ("b", 1, 0), ("total", 3, 1)]
    names = spark.createDataFrame([("City of Toronto",), ("Toronto Hydro",), ("Halton County",), ("County Power Corp",)], "n string")
    # a leading "County" excludes whatever follows
    assert rows(names.where(footprint.is_public(F.col("n"))), "n") == [("City of Toronto",), ("County Power Corp",), ("Halton County",)]


@pytest.mark.parametrize("parts", [1, 7])
def test_order_does_not_depend_on_partitions(spark, parts):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id").repartition(parts)
    assert rows(dedupe.keep_first(df, ["k"], ["id"]), "k", "id") == [(i, i) for i in range(7)]


def test_malformed_files_are_named(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"searchResults": [{"_id": "1"}, {"_id": "2"}]}, {"searchResults": [{"_id": "3"}]}]')
    (tmp_path / "b.json").write_text('{"searchResults": [')
    got = sorted((r.pos, r._id) for r in readers.nested(spark, str(tmp_path), "searchResults", "_id:string").collect())
    assert got == [(0, "1"), (1, "2")]
    bad = readers.quarantine(spark, str(tmp_path)).collect()
    assert [r._file.rpartition("/")[2] for r in bad] == ["b.json"]
    assert readers.quarantine(spark, str(tmp_path / "none")).count() == 0


def test_table_moves_in_only_when_it_changed(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one, two = spark.range(3), spark.range(4)
    assert writers.if_changed(one, path) and not writers.if_changed(spark.range(3), path)
    assert writers.if_changed(two, path) and spark.read.parquet(path).count() == 4
    (tmp_path / "t").rename(tmp_path / "t.last")  # as a crash between the moves leaves it
    assert not writers.if_changed(spark.range(4), path) and spark.read.parquet(path).count() == 4


@pytest.mark.parametrize(("place", "want"), [("Kincardine to Milton", "Kincardine"), ("City of Greater Sudbury (north)", "Greater Sudbury"), ("near the Town of Ajax, ", "Ajax"), ("x; y", None), (None, None), ("Lot 5, Township of Perth; other", "Perth"), ("between Bath and Odessa", "Bath")])
def test_places(spark, place, want):
    from dossier.functions import text

    assert spark.createDataFrame([(place,)], "x string").select(text.municipality(F.col("x")).alias("m")).first().m == want


def test_keys_and_links(spark):
    from dossier.functions import web

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(web.object_key(F.lit("on"), F.lit("P%201"), F.lit("https://x/a/My%20File%2b.pdf?q"))) == "on/P_1/My_File_.pdf"
    assert one(web.object_key(F.lit("on"), F.lit("p"), F.lit("https://x/a/plain"))).endswith(".html")
    assert one(web.object_key(F.lit("bc"), F.lit("p"), F.lit("https://x/document/" + "a1" * 12 + "/download"))) == "bc/p/" + "a1" * 12 + ".pdf"
    assert one(web.object_key(F.lit("bc"), F.lit("p"), F.lit("https://x/"))) == "bc/p/file"
    assert one(web.object_key(F.lit("qc"), F.lit("p"), F.lit("https://x/dl/"))) == "qc/p/file.pdf"
    assert one(web.object_key(F.lit("federal"), F.lit("p"), F.lit("https://x/y.doc"))) == "federal/p/y.doc"
    assert one(web.clean_url(F.lit("https://a/é [x]?b c#d"))) == "https://a/%C3%A9%20%5Bx%5D?b%20c"
    assert one(web.followed(F.lit("https://a/outage/mine"), F.lit("environment"), 0)) is False
    assert one(web.followed(F.lit(None).cast("string"), F.lit("environment"), 0)) is False


def test_crosswalk_refuses_strangers(spark):
    from dossier.operators import enrich

    seed = spark.createDataFrame([("a",), ("b",)], "k string")
    known = spark.createDataFrame([("P1",)], "pid string")
    good = spark.createDataFrame([("a", "P1"), ("b", None)], "k string, pid string")
    assert enrich.crosswalk(seed, good, "k", known, "pid").count() == 2
    for bad in ([("a", "P1")], [("a", "P1"), ("b", "P9")]):
        with pytest.raises(ValueError):
            enrich.crosswalk(seed, spark.createDataFrame(bad, "k string, pid string"), "k", known, "pid")


def test_instruments(spark):
    from dossier.functions import text

    pages = ["NOTICE OF REVOCATION NUMBER 1234-ABCDEF Issue Date: April 5, 2013", "AMENDMENT TO RENEWABLE ENERGY APPROVAL NUMBER 1111-222222", "RENEWABLE ENERGY APPROVAL", "You are notified that I have amended Approval No. 1234-ABCDEF, issued on May 2, 2012", "lunch"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string")
    got = [r for r in df.select("i", *[c.alias(k) for k, c in text.instrument(F.col("p")).items()]).orderBy("i").collect()]
    assert [r.kind for r in got] == ["revocation", "amendment", "approval", "amendment", "other"]
    assert (got[0].issue_date, got[0].rea_number) == ("2013-04-05", "1234-ABCDEF")
    assert (got[3].amends_number, got[3].amends_date) == ("1234-ABCDEF", "2012-05-02")


def test_distance_of_a_missing_place_is_unknown(spark):
    from dossier.functions import geo

    df = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0), (None, 0.0, 0.0, 90.0), (0.0, 0.0, 0.0, None)], "a double, b double, c double, d double")
    got = [r.km for r in df.select(geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km")).collect()]
    assert got[0] == pytest.approx(6371.0 * 3.141592653589793 / 2) and got[1:] == [None, None]


def test_documents_by_one_telling_token_or_two(spark):
    """Three projects with the same two tokens are met by none: two hits want a rare
    one, and a long one counts alone only.  Folders count where nothing else does."""
    p = spark.createDataFrame([("o", i, ["waasigan", "corridor"]) for i in (1, 2, 3)] + [("o", 4, ["lakeshore", "wind"]), ("o", 5, ["northern", "wind"]), ("q", 6, ["lakeshore"])], "owner string, project_id long, tok array<string>")
    docs = [(1, ["waasigan", "corridor", "plan"], []), (2, ["waasigan"], []), (3, ["lakeshore", "wind"], []), (4, ["wind"], []), (5, ["notes"], ["documents", "northern"]), (6, ["lakeshore"], ["northern"]), (7, ["waasigan", "corridor"], ["waasigan"]), (8, [], ["wind"])]
    d = spark.createDataFrame([("o", *x) for x in docs] + [("q", 9, ["lakeshore"], None)], "owner string, doc_id long, words array<string>, folders array<string>")
    got = {r.doc_id: (r.project_id, r.hits) for r in match.match_documents(d, p).collect()}
    # 7: two hits fail, so the folder rule meets the first of the three
    assert got == {2: (1, 1), 3: (4, 2), 5: (5, 1), 6: (4, 1), 7: (1, 1), 9: (6, 1)}


def test_public_bodies(spark):
    public = ["City of Toronto", "the Ministère X", "University of Guelph", "Grand River Hospital", "Moose Cree First Nation", "Parks Canada", "Gaming Commission", "Aéroport de Québec", "Department of Energy", "Halton County", "Town Mining"]
    others = ["Ontario Power Generation", "University Power Corp", "Regional Gold Mines", "Acme Inc", "Corp Ltd", "Bandwidth Ltd", "Cityscape", "Nationwide Resources Agency"]
    df = spark.createDataFrame([(n,) for n in public + others], "n string")
    assert {r.n for r in df.where(footprint.is_public(F.col("n"))).collect()} == set(public)


def test_layer_titles_are_met_inside_words(spark):
    layers = spark.createDataFrame([("a", "land"), ("b", "of on"), ("c", "x"), ("d", ""), ("e", "Wetlands of Ontario"), ("f", "lando")], "label string, match string")
    entries = spark.createDataFrame([(1, "Nothing", "u1"), (2, "Wetlands of Ontario", "u2"), (3, "Islands", "u3"), (4, "x", ""), (5, "A x", "u5"), (6, None, "u6")], "ord int, title string, link string")
    assert dict(rows(enrich.layer_titles(layers, entries), "label", "link")) == {"a": "u2", "b": "u2", "c": "u5", "d": "u1", "e": "u2"}


def _masses(ext, ours):
    n = len(ours)
    df = {}
    for toks in ours.values():
        for t in set(toks):
            df[t] = df.get(t, 0) + 1
    weight = lambda t: math.log((n + 1) / (df[t] + 1)) + 1 if t in df else math.log(n + 1.0) + 1
    out = {}
    for e, a in ext.items():
        for o, b in ours.items():
            both = set(a) & set(b)
            if both:
                mass = sum(map(weight, both))
                out[e, o] = (len(both), mass / sum(map(weight, set(a))), mass / sum(map(weight, set(b))))
    return out


def _sides(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    bag = lambda k: list(dict.fromkeys(rng.choices(words, weights, k=k)))
    ours = {i: bag(rng.randrange(4, 30)) for i in range(60)}
    ext = {i: (rng.sample(ours[i], max(1, len(ours[i]) * 2 // 3)) if i % 2 else bag(8)) for i in range(30)}
    schema = "tok array<string>, prop_tok array<string>, lon double, lat double, region long"
    e = spark.createDataFrame([(i, t, [], None, None, i % 3) for i, t in ext.items()], f"ext_id long, {schema}")
    o = spark.createDataFrame([(i, i, t, [], None, None, i % 3) for i, t in ours.items()], f"our_id long, ord long, {schema}")
    return ext, ours, e, o


@pytest.mark.parametrize("seed", range(3))
def test_anchors_lose_no_pair_that_counts(spark, seed):
    """By every share that may be asked for, and fewer pairs than share any token."""
    ext, ours, e, o = _sides(spark, seed)
    known = _masses(ext, ours)
    idf, n = match.document_frequency(o), o.agg(F.count("*").alias("n"))
    for share in (0.2, 0.5, 0.8):
        got = {(r.ext_id, r.our_id): r.mass / r.ext_mass for r in match.coverage(e.drop("region"), o, idf, n, share=share, mutual=True).collect()}
        want = {k: v[1] for k, v in known.items() if min(v[1:]) >= share}
        assert set(want) <= set(got) and all(got[k] == pytest.approx(known[k][1]) for k in got) and len(got) < len(known)
    best = {r.ext_id: (r.our_id, r.score) for r in match.best_match(e, o).collect()}
    for i in ext:
        score, ours_ = max(((round(v[1], 9), -k[1]) for k, v in known.items() if k[0] == i), default=(0.0, None))
        assert best[i] == (ours_ if ours_ is None else -ours_, pytest.approx(round(score, 6)))
    pairs = {}
    for (i, j), (shared, a, b) in known.items():
        if shared >= 2 and max(a, b) >= 0.72 and min(a, b) >= 0.5 and i % 3 == j % 3:
            pairs.setdefault(i, []).append((round((a + b) / 2, 9), -j))
    got = {r.our_id: r.ext_id for r in match.bidirectional(e, o).collect()}
    firsts = {}
    for i, found in pairs.items():
        score, j = max(found)
        firsts.setdefault(-j, []).append((round(score, 3), -i))
    assert got == {j: -max(x)[1] for j, x in firsts.items()}
