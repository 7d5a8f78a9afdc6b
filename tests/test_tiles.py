"""Tiled routes against the search that holds a whole area."""

import math
import random

import pytest

from dossier.operators import route, tiles

ENDS = "area long, r0 long, c0 long, r1 long, c1 long"


def grid(spark, areas, height, width, seed, holes=0.1):
    rng = random.Random(seed)
    return spark.createDataFrame([(a, r, c, rng.uniform(1, 20)) for a in range(areas) for r in range(-3, height - 3) for c in range(width) if rng.random() >= holes or (r, c) in ((-3, 0), (height - 4, width - 1))], "area long, row long, col long, cost double")


def paths(df):
    out = {}
    for r in df.orderBy("area", "route", "seq").collect():
        out.setdefault((r.area, r.route), []).append((r.seq, r.row, r.col, r.cost))
    return out


@pytest.mark.parametrize(("tile", "k"), [(6, 1), (32, 2)])
def test_equal_to_one_group_an_area(spark, tile, k):
    df = grid(spark, 2, 14, 19, tile)
    ends = spark.createDataFrame([(a, -3, 0, 10, 18) for a in range(2)], ENDS)
    got = paths(tiles.routes(df, ends, k, 1.35, 2, tile))
    assert got == paths(route.routes(df, ends, k, 1.35, 2)) and len(got) == 2 * k


def test_ways_that_leave_a_tile_and_come_back(spark):
    """A wall sends the route through other tiles and back into the first."""
    rows = [(0, r, c, 1.0) for r in range(8) for c in range(8) if not (c == 2 and r < 7)]
    df = spark.createDataFrame(rows, "area long, row long, col long, cost double")
    t = tiles.grid_tiles(df, 4)
    ends = spark.createDataFrame([(0, 0, 0, 0, 3)], ENDS)
    got = paths(tiles.routes(df, ends, 1, tile=4))[0, 0]
    assert [x[0] for x in got] == list(range(len(got))) and got[0][1:3] == (0, 0) and got[-1][1:3] == (0, 3)
    length = sum(math.dist(a[1:3], b[1:3]) for a, b in zip(got, got[1:], strict=False))
    best = paths(route.routes(df, ends, 1))[0, 0]
    assert length == pytest.approx(sum(math.dist(a[1:3], b[1:3]) for a, b in zip(best, best[1:], strict=False)))
    assert t.count() == 4


def test_no_way_and_start_at_the_goal(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 5, 5, 1.0), (1, 2, 2, 3.0)], "area long, row long, col long, cost double")
    ends = spark.createDataFrame([(0, 0, 0, 5, 5), (1, 2, 2, 2, 2)], ENDS)
    assert paths(tiles.routes(df, ends, 1, tile=4)) == {(1, 0): [(0, 2, 2, 3.0)]}
