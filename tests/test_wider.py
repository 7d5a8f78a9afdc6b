"""Rows that the small tables don't have, or that only larger tables show."""

import math
import random
import shutil

from compare import connect, same
from dossier import queries
from dossier.operators import enrich, match, shapes, spatial

FOLDER = "/root/testdata/sf0.001"


def _folder(to, **tables):
    """A copy of the smallest tables with some of them replaced."""
    shutil.copytree(FOLDER, to, copy_function=shutil.copyfile)
    to.chmod(0o755)
    for name, rows in tables.items():
        (to / f"{name}.parquet").unlink()
        rows.write.parquet(f"{to}/{name}.parquet")
    return str(to)


def _equal(spark, name, folder):
    return same(spark, connect(folder), queries.queries()[name], queries.oracle_sql()[name], folder)


def test_rare_anchors_ask_for_no_region(spark):
    """Pairs of different regions count, unless they are to be left out."""
    schema = "tok array<string>, region long"
    e = spark.createDataFrame([(1, ["rare", "often"], 1), (2, ["often"], 2)], f"ext_id long, {schema}")
    o = spark.createDataFrame([(1, ["rare", "often"], 2), (2, ["rare"], 1), (3, ["often"], 1)], f"our_id long, {schema}")
    idf, n = match.document_frequency(o), match.document_frequency(o).selectExpr("3L AS n").limit(1)
    idf = idf.selectExpr("token", "if(token = 'rare', 2L, 9L) AS df", "idf")
    found = lambda **more: {(r.ext_id, r.our_id, r.shared) for r in match.coverage(e, o, idf, n, 2, **more).collect()}
    assert found() == {(1, 1, 2), (1, 2, 1)}
    assert found(apart=True) == {(1, 2, 1)}


def test_values_are_compared_before_they_are_rounded(spark, tmp_path):
    values = {2: 9899.49, 4: 9899.5, 6: 9899.99, 8: 9900.0, 10: 9900.27, 12: 9900.5, 13: 9950.0, 14: None}
    rows = [(k, f"C{k}", k % 25, v, "BUILDING") for k, v in values.items()]
    customer = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    folder = _folder(tmp_path / "t", customer=customer)
    assert _equal(spark, "checks_that_may_crash", folder) == 2 + 3


def test_distances_near_a_pole_and_past_the_end_of_a_turn(spark):
    """Meridians draw together: a box as wide as at the place's own latitude is too narrow."""
    rng = random.Random(3)
    spots = [(rng.uniform(-180, 180), rng.choice((rng.uniform(78, 90), rng.uniform(-90, 90)))) for _ in range(300)]
    spots += [(179.9, 10.0), (-179.9, 10.0), (180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (90.0, 90.0), (5.0, -89.9), (-170.0, -89.9)]

    def km(a, b):
        (x1, y1), (x2, y2) = ((math.radians(v) for v in p) for p in (a, b))
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))

    rows = [(i, x, y) for i, (x, y) in enumerate(spots)]
    a = spark.createDataFrame([*rows, (900, None, 1.0)], "point_id long, lon double, lat double")
    b = spark.createDataFrame([*rows, (901, 1.0, None)], "hit_id long, lon double, lat double")
    for far in (30, 400, 2500):
        want = {(i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if km(p, q) <= far}
        got = [(r.point_id, r.hit_id) for r in spatial.within(a, b, far, 2.0 if far > 30 else 0.7).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    rules = spark.createDataFrame([("k", 400.0, "noise")], "kind string, km double, discipline string")
    kinds = b.selectExpr("'k' AS kind", "lon", "lat")
    got = {r.point_id: r.features for r in spatial.triggered(a, kinds, rules, 2.0).collect()}
    assert got == {i: sum(km(p, q) <= 400 for q in spots) for i, p in enumerate(spots)}


def test_equal_rows_are_searched_once(spark, monkeypatch):
    """Copies are found and ranked as rows of their own, by one pair for each two classes."""
    schema = "tok array<string>, prop_tok array<string>, lon double, lat double"
    names = [["red", "ring"], ["ring", "red", "red"], ["small", "bolt"], ["red", "bolt"], []]
    ours = [(i, 100 - i, names[i % 5], ["b1"] if i % 2 else ["b2"], None, None) for i in range(60)]
    ext = [(i, [["red", "bolt"], ["bolt", "red"], ["no such"]][i % 3], ["b1", "p"] if i % 4 else [], None, None) for i in range(48)]
    e, o = spark.createDataFrame(ext, f"ext_id long, {schema}"), spark.createDataFrame(ours, f"our_id long, ord long, {schema}")
    sizes, coverage = [], match.coverage

    def counted(e, o, *more, **named):
        sizes.append((e.count(), o.count()))
        return coverage(e, o, *more, **named)

    monkeypatch.setattr(match, "coverage", counted)
    got = {r.ext_id: (r.our_id, r.score, r.name_score, r.verdict) for r in match.best_match(e, o).collect()}
    assert sizes and max(n for n, _ in sizes) <= 4 and max(n for _, n in sizes) <= 8
    # the same from one external row at a time, which no other row can stand for
    idf = {t: math.log(61 / (1 + sum(t in x[2] for x in ours))) + 1 for t in ("red", "ring", "small", "bolt")}
    weight = lambda t: idf.get(t, math.log(61) + 1)
    for i, tok, prop, *_ in ext:
        found = []
        for j, order, name, their, *_ in ours:
            part = sum(weight(t) for t in set(tok) & set(name)) / sum(map(weight, tok))
            # frequencies are those of name tokens, so proponents' are unseen
            score = part + (0.25 * len(set(prop) & set(their)) / len(prop) if prop else 0)
            found += [(round(score, 9), -order, j, part)] if part else []
        score, _, j, part = max(found, default=(0.0, 0, None, 0.0))
        assert got[i][:3] == (j, round(score, 6), round(part, 6))
    assert len(got) == len(ext)


def _broadcasts(df):
    """What the plan would send from the driver to all tasks."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "BroadcastExchange" in line]


def test_runs_of_letters_are_never_broadcast(spark, tmp_path):
    """Spark doesn't know how many there are of the second side's; titles weigh once."""
    rows = [(9, "Red Gear", "l9"), (3, "red gear", "l3"), (1, "red gear", ""), (5, "blue ring", "l5"), (7, None, "l7"), (8, "red gear", None)]
    spark.createDataFrame(rows, "ord long, title string, link string").write.parquet(f"{tmp_path}/e")
    entries = spark.read.parquet(f"{tmp_path}/e")
    layers = spark.createDataFrame([("A", "GEAR"), ("B", "e ri"), ("C", "none"), ("D", "")], "label string, match string")
    df = enrich.layer_titles(layers, entries)
    assert not _broadcasts(df)
    assert {tuple(r) for r in df.collect()} == {("A", "red gear", "l3"), ("B", "blue ring", "l5"), ("D", "red gear", "l3")}


def test_cells_of_shapes_are_never_broadcast(spark, tmp_path):
    """Neither by pairs nor counted, and both say the same."""
    rng = random.Random(5)
    at = lambda: (round(rng.uniform(-6, 6), 1), round(rng.uniform(-6, 6), 1))
    places = [(i, *at()) for i in range(300)] + [(900 + i, 1.0, 1.0) for i in range(4)] + [(990, None, 1.0)]
    grounds = [(i, i % 4 > 0, (i % 3) * 0.3, [[at() for _ in range(1 + i % 5)]]) for i in range(40)]
    spark.createDataFrame(places, "place_id long, x double, y double").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(grounds, "shape_id long, closed boolean, buffer double, rings array<array<struct<x:double,y:double>>>").write.parquet(f"{tmp_path}/g")
    p, g = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/g")
    assert not _broadcasts(shapes.cover(g, 0.5)) and not _broadcasts(shapes.inside(p, g, 0.5))
    found = {}
    for r in shapes.inside(p, g, 0.5).collect():
        found.setdefault(r.place_id, []).append(r.shape_id)
    assert found and all(len(v) == len(set(v)) for v in found.values())
    got = {r.place_id: (r.first, r.n) for r in shapes.counted(p, g, 0.5).collect()}
    assert got == {i: (min(found[i]), len(found[i])) if i in found else (None, 0) for i, *_ in places}


def test_words_of_texts_are_not_shuffled_to_meet_a_few_heads(spark):
    plan = queries.queries()["gazetteer_cascade"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    met = [line for line in plan.split("\n") if "Join" in line and "head#" in line]
    assert len(met) == 1 and "BroadcastHashJoin" in met[0]
