"""Shapes on grid cells against a plain test of every place with every shape."""

import math
import random

import pytest

from dossier.operators import shapes

SCHEMA = "shape_id long, ord long, name string, closed boolean, buffer double, rings array<array<struct<x:double,y:double>>>"


def apart(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def contains(p, closed, buffer, rings):
    odd, near = False, False
    for ring in rings or []:
        pairs = list(zip(ring, ring[1:] + ring[:1], strict=True)) if closed or len(ring) == 1 else list(zip(ring, ring[1:], strict=False))
        for a, b in pairs:
            near |= apart(p, a, b) <= (buffer or 0.0)
            if closed and (a[1] > p[1]) != (b[1] > p[1]):
                odd ^= p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]
    return odd or near


def star(rng, x, y, size, n):
    return [(x + size * rng.uniform(0.2, 1) * math.cos(2 * math.pi * i / n), y + size * rng.uniform(0.2, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def made(seed):
    rng = random.Random(seed)
    out = []
    for i in range(40):
        x, y, size = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.3, 2, 9])
        ring = star(rng, x, y, size, rng.randrange(3, 12))
        hole = [(x + (a - x) / 5, y + (b - y) / 5) for a, b in ring]
        kind = i % 4
        rings = [ring] if kind == 0 else [ring, hole] if kind == 1 else [ring] if kind == 2 else [[(x, y)]]
        out.append((i, 100 - i, f"n{i}", kind < 2, rng.choice([None, 0.0, 0.4, 3.0]), rings))
    # whole numbers: corners and edges on lines of the grid, and on places
    out += [(50, 1, "box", True, 0.0, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]), (51, 2, "hole", True, None, [[(-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0)], [(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)]])]
    out += [(52, 3, "none", True, 1.0, []), (53, 4, "null", True, 1.0, None), (54, 5, "empty", False, 1.0, [[]]), (55, 6, "up", False, 1.0, [[(3.0, -5.0), (3.0, 5.0)]])]
    places = [(i, rng.uniform(-25, 25), rng.uniform(-25, 25)) for i in range(600)]
    places += [(1000 + 20 * x + y, float(x - 10), float(y - 10)) for x in range(20) for y in range(20)] + [(9000, None, 1.0), (9001, 1.0, None)]
    return out, places


@pytest.mark.parametrize("size", [0.5, 1.0, 7.3, 100.0])
def test_inside_equals_a_test_of_all(spark, size):
    table, places = made(2)
    got = {tuple(r) for r in shapes.inside(spark.createDataFrame(places, "place_id long, x double, y double"), spark.createDataFrame(table, SCHEMA), size).collect()}
    known = [p for p in places if None not in p]
    want = {(p[0], s[0]) for p in known for s in table if contains(p[1:], s[3], s[4], s[5])}
    # far from any rounding: no place lies as far off as a buffer says
    assert got == want


def test_most_places_need_no_test(spark):
    """Of a large shape most cells are inner ones."""
    ring = [(100 * math.cos(i / 50 * math.pi), 100 * math.sin(i / 50 * math.pi)) for i in range(100)]
    df = spark.createDataFrame([(1, 1, "disc", True, 5.0, [ring])], SCHEMA)
    kinds = {r.sure: r["count"] for r in shapes.cover(df, 2.0).groupBy("sure").count().collect()}
    assert kinds[True] > 4 * kinds[False]


def test_first_shape_by_order(spark):
    box = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    df = spark.createDataFrame([(1, 2, "late", True, 0.0, box), (2, 1, "early", True, 0.0, box), (3, 0, "far", True, 0.0, [[(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]])], SCHEMA)
    places = spark.createDataFrame([(1, 1.0, 1.0), (2, 50.0, 1.0)], "place_id long, x double, y double")
    assert {tuple(r) for r in shapes.first_inside(places, df, 1.0).collect()} == {(1, "early"), (2, None)}


def test_burn(spark):
    layers = spark.createDataFrame(
        [("park", ["nature", "people"], "3", None, [(1.5, 2.0)]), ("mine", ["nature"], "FB", 1.0, []), ("lost", ["none"], "5", None, None)],
        "layer string, categories array<string>, resistance string, ring_m double, rings array<struct<buffer:double,resistance:double>>",
    )
    weights = spark.createDataFrame([("nature", 0.5), ("people", 0.25)], "category string, weight double")
    rings = shapes.rings_of(layers, weights)
    assert {tuple(r) for r in rings.collect()} == {("park", 0, 0.0, 2.25), ("park", 1, 1.5, 1.5), ("mine", 0, 1.0, 14000.0), ("lost", 0, 0.0, 0.0)}
    box = lambda x, y, w: [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]
    rows = [("a", 1, "park", True, box(2.0, 2.0, 4.0)), ("a", 2, "park", True, box(3.0, 3.0, 4.0)), ("a", 3, "mine", False, [[(0.0, 12.0), (12.0, 12.0)]]), ("b", 4, "mine", False, [[(5.2, 5.2)]])]
    df = spark.createDataFrame(rows, "area string, shape_id long, layer string, closed boolean, rings array<array<struct<x:double,y:double>>>")
    cells = [(a, r, c) for a in "abc" for r in range(14) for c in range(14)]
    got = {(r.area, r.row, r.col): r.cost for r in shapes.burn(spark.createDataFrame(cells, "area string, row int, col int"), df, rings, 1.0, 3).collect()}
    want = {}
    for a, r, c in cells:
        at = (c + 0.5, r + 0.5)
        value = 0.0
        for layer, _, buffer, v in [tuple(x) for x in rings.collect()]:
            if any(s[0] == a and s[2] == layer and contains(at, s[3], buffer, s[4]) for s in rows):
                value += v
        want[a, r, c] = value
    low = {a: min(v for k, v in want.items() if k[0] == a) for a in "abc"}
    assert got == pytest.approx({k: v - low[k[0]] + 1 for k, v in want.items()})
    assert max(got.values()) > 14000 and {v for k, v in got.items() if k[0] == "c"} == {1.0}


def test_shapes_of_a_kind_that_hold_a_cell_are_not_tested_again(spark, monkeypatch):
    from pyspark.sql import functions as F

    cells = spark.range(100).select(F.lit("a").alias("area"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    square = "array(array(struct(-20D AS x, -20D AS y), struct(30D AS x, -20D AS y), struct(30D AS x, 30D AS y), struct(-20D AS x, 30D AS y)))"
    df = spark.range(60).selectExpr("'a' AS area", "id AS shape_id", "'ground' AS layer", "true AS closed", f"{square} AS rings")
    rings = spark.createDataFrame([("ground", 0, 0.0, 2.0), ("ground", 1, 0.5, 1.0)], "layer string, ring int, buffer double, value double")
    met, cut = [], shapes.cut

    def counted(frame):
        out = cut(frame)
        met.append(out.count() if "place_id" in out.columns and "shape_id" in out.columns else 0)
        return out

    monkeypatch.setattr(shapes, "cut", counted)
    narrow, wide = ({tuple(r) for r in shapes.burn(cells, df, rings, 1.0, join).collect()} for join in (1, 8))
    assert narrow == wide == {("a", r, c, 1.0) for r in range(10) for c in range(10)}
    assert sum(met) < 100 * 60
