"""Least-cost routes over grids that fit no task.

A grid is cut into tiles; each knows its own cells and a rim of its neighbours'.  A tile
with news from its rim relaxes its own distances and tells neighbours what changed along
its border, until no tile has news: every distance is then the least.  A route is traced
back from its end, tile by tile: each walks to where the route enters it and hands the
rest to the tile that lies there.  A task holds one tile at a time.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

# How much dearer a route makes its surroundings, and how far around.
PENALTY, WINDOW = 1.35, 5
TILE = 128
_STEPS = [(dr, dc, math.hypot(dr, dc)) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
_NEWS = "array<struct<row:long,col:long,d:double>>"


def grid_tiles(costs: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles (area, tr, tc, cost) of cells (area, row, col, cost): the costs of the
    tile's cells and of a rim of one cell, row by row; NaN where there is none."""
    near = lambda c: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor((F.col(c) + i) / tile)))
    spread = costs.select("area", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "cost").select("*", F.explode(near("row")).alias("tr")).select("*", F.explode(near("col")).alias("tc"))
    width = tile + 2
    at = (F.col("row") - F.col("tr") * tile + 1) * width + F.col("col") - F.col("tc") * tile + 1
    own = (F.floor(F.col("row") / tile) == F.col("tr")) & (F.floor(F.col("col") / tile) == F.col("tc"))
    rows = spread.groupBy("area", "tr", "tc").agg(F.collect_list(F.struct(at.cast("int").alias("at"), "cost")).alias("cells"), F.bool_or(own).alias("own")).where("own")

    def laid(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for cells in frame["cells"]:
                cost = np.full(width * width, np.nan)
                cost[[c["at"] for c in cells]] = [c["cost"] for c in cells]
                out.append(cost)
            yield frame[["area", "tr", "tc"]].assign(cost=out)

    return rows.mapInPandas(laid, f"area {costs.schema['area'].dataType.simpleString()}, tr long, tc long, cost array<double>")


def _relax(tile: int):
    """(area, tr, tc, cost, dist, news) to the tile's distances and news of its own."""
    width = tile + 2

    def one(tr: int, tc: int, cost: np.ndarray, dist: np.ndarray, news: list) -> list[tuple]:
        heap, changed = [], set()
        inside = lambda r, c: 0 < r <= tile and 0 < c <= tile
        for m in news:
            r, c = m["row"] - tr * tile + 1, m["col"] - tc * tile + 1
            if m["d"] < dist[r, c] and not math.isnan(cost[r, c]):
                dist[r, c] = m["d"]
                heap.append((m["d"], r, c))
                if inside(r, c):
                    changed.add((r, c))
        heapq.heapify(heap)
        costs, best = cost.tolist(), dist.tolist()
        while heap:
            d, r, c = heapq.heappop(heap)
            if d > best[r][c]:
                continue
            for dr, dc, length in _STEPS:
                y, x = r + dr, c + dc
                if inside(y, x) and d + (costs[r][c] + costs[y][x]) / 2 * length < best[y][x]:
                    best[y][x] = d + (costs[r][c] + costs[y][x]) / 2 * length
                    changed.add((y, x))
                    heapq.heappush(heap, (best[y][x], y, x))
        dist[:] = best
        out = []
        for r, c in changed:
            row, col = r - 1 + tr * tile, c - 1 + tc * tile
            for to in {((row + dr) // tile, (col + dc) // tile) for dr in (-1, 0, 1) for dc in (-1, 0, 1)} - {(tr, tc)}:
                out.append((*to, row, col, best[r][c]))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for area, tr, tc, cost, dist, news in frame.itertuples(index=False, name=None):
                d = np.array(dist, float).reshape(width, width) if dist is not None else np.full((width, width), np.inf)
                told = one(tr, tc, np.array(cost, float).reshape(width, width), d, list(news))
                rows.append((area, tr, tc, d.ravel(), [dict(zip(("tr", "tc", "row", "col", "d"), m, strict=True)) for m in told]))
            yield pd.DataFrame(rows, columns=["area", "tr", "tc", "dist", "told"])

    return run


def distances(tiles: DataFrame, starts: DataFrame, tile: int = TILE) -> DataFrame:
    """The least cost from each area's start (area, row, col) to all cells, by tile:
    area, tr, tc and dist (laid out as cost; tiles without a way aren't there)."""
    key = ["area", "tr", "tc"]
    area = tiles.schema["area"].dataType.simpleString()
    at = starts.select("area", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc"), F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.lit(0.0).alias("d")).alias("m"))
    news = at.groupBy(*key).agg(F.collect_list("m").alias("news"))
    state = None
    told = "told array<struct<tr:long,tc:long,row:long,col:long,d:double>>"
    while True:
        work = tiles.join(news, key)
        if state is None:
            work, rest = work.select(*key, "cost", F.lit(None).cast("array<double>").alias("dist"), "news"), None
        else:
            old = state.select(*(F.col(c).alias(f"{c}_") for c in key), "dist")
            work = work.join(old, F.expr(" AND ".join(f"{c} = {c}_" for c in key)), "left").select(*key, "cost", "dist", "news")
            rest = state.join(news.select(*(F.col(c).alias(f"{c}_") for c in key)), F.expr(" AND ".join(f"{c} = {c}_" for c in key)), "left_anti")
        done = work.mapInPandas(_relax(tile), f"area {area}, tr long, tc long, dist array<double>, {told}")
        if rest is not None:  # tiles without news stay as they are and tell nothing
            done = done.unionByName(rest.withColumn("told", F.array().cast(told.removeprefix("told "))))
        state = cut(done)
        said = state.select("area", F.explode("told").alias("m")).select("area", "m.tr", "m.tc", F.struct("m.row", "m.col", "m.d").alias("m"))
        if said.first() is None:
            return state.select(*key, "dist")
        news = said.groupBy(*key).agg(F.collect_list("m").alias("news"))


def _walk(tile: int):
    """(area, tr, tc, cost, dist, row, col) to the cells of the route from there back to
    where it enters the tile, and the cell ahead of that, null at the start."""
    width = tile + 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for area, tr, tc, cost, dist, row, col in frame.itertuples(index=False, name=None):
                w, d = np.array(cost, float).reshape(width, width), np.array(dist, float).reshape(width, width)
                r, c, cells, ahead = row - tr * tile + 1, col - tc * tile + 1, [], None
                while math.isfinite(d[r, c]):
                    cells.append((r - 1 + tr * tile, c - 1 + tc * tile))
                    if d[r, c] == 0:
                        break
                    # the neighbour by which this distance came, to the last bit
                    r, c = next((r + dr, c + dc) for dr, dc, length in _STEPS if d[r + dr, c + dc] + (w[r + dr, c + dc] + w[r, c]) / 2 * length == d[r, c])
                    if not (0 < r <= tile and 0 < c <= tile):
                        ahead = (r - 1 + tr * tile, c - 1 + tc * tile)
                        break
                rows.append((area, [{"row": y, "col": x} for y, x in cells], *(ahead or (None, None))))
            yield pd.DataFrame(rows, columns=["area", "cells", "row", "col"]).astype({"row": "Int64", "col": "Int64"})

    return run


def traced(tiles: DataFrame, dist: DataFrame, goals: DataFrame, tile: int = TILE) -> DataFrame:
    """The routes to each area's goal (area, row, col): area, seq from the start, row and
    col.  Areas whose goal can't be reached have none."""
    key = ["area", "tr", "tc"]
    area = tiles.schema["area"].dataType.simpleString()
    both = tiles.join(dist, key)
    at, leg, legs = goals.select("area", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")), 0, []
    while at is not None:
        work = at.withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile)).join(both, key).select(*key, "cost", "dist", "row", "col")
        done = cut(work.mapInPandas(_walk(tile), f"area {area}, cells array<struct<row:long,col:long>>, row long, col long"))
        legs.append(done.select("area", F.lit(leg).alias("leg"), F.posexplode("cells").alias("place", "cell")))
        at, leg = done.where("row IS NOT NULL").select("area", "row", "col"), leg + 1
        if at.first() is None:
            at = None
    back = legs[0]
    for more in legs[1:]:
        back = back.unionByName(more)
    # legs and places count from the goal; a leg's length is a small table
    size = back.groupBy("area", "leg").agg(F.count("*").alias("n"))
    later = size.select(F.col("area").alias("a"), F.col("leg").alias("l"), "n")
    behind = size.drop("n").join(later, (F.col("area") == F.col("a")) & (F.col("l") >= F.col("leg"))).groupBy("area", "leg").agg(F.sum("n").alias("left"))
    return back.join(behind, ["area", "leg"]).select("area", (F.col("left") - F.col("place") - 1).alias("seq"), "cell.row", "cell.col")


def routes(costs: DataFrame, ends: DataFrame, k: int = 3, penalty: float = PENALTY, window: int = WINDOW, tile: int = TILE) -> DataFrame:
    """k routes for each area between its ends (area, r0, c0, r1, c1): area, route, seq,
    row, col and cost (of the unpenalised grid), as ``route.routes`` gives them for grids
    of one task.  After each route the cells within ``window`` of every cell of it cost
    ``penalty`` times as much, again for each."""
    now, out = cut(costs.select("area", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "cost")), None  # read for tiles and for the result
    base = now
    goals = ends.select("area", F.col("r1").alias("row"), F.col("c1").alias("col"))
    starts = ends.select("area", F.col("r0").alias("row"), F.col("c0").alias("col"))
    for i in range(k):
        tiles = cut(grid_tiles(now, tile))
        path = cut(traced(tiles, distances(tiles, starts, tile), goals, tile).withColumn("route", F.lit(i).cast("long")))
        out = path if out is None else out.unionByName(path)
        if i + 1 < k:
            around = F.sequence(F.lit(-window), F.lit(window))
            near = path.select("area", "row", "col", F.explode(around).alias("dr")).select("area", "row", "col", "dr", F.explode(around).alias("dc"))
            times = near.groupBy("area", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(F.count("*").cast("int").alias("times"))
            dearer = F.aggregate(F.sequence(F.lit(1), F.col("times")), F.col("cost"), lambda x, _: x * penalty)
            now = now.join(times, ["area", "row", "col"], "left").select("area", "row", "col", F.when(F.col("times").isNull(), F.col("cost")).otherwise(dearer).alias("cost"))
    return out.join(base, ["area", "row", "col"]).select("area", "route", "seq", "row", "col", "cost")
