"""Weighted cost grids and least-cost routes.

The grid of one study area fits one task; areas are groups, so many areas are
routed at once."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def burn(cells: DataFrame, layers: DataFrame, base: float = 1.0) -> DataFrame:
    """Cost of each cell (area, row, col): base plus every layer's value at points
    within its radius, once a layer and ring, shifted so that the least is 1.

    layers: area, layer, ring, row, col, radius (in cells), value."""
    reach = layers.select("area", "layer", "ring", "radius", "value", F.col("row").alias("r0"), F.col("col").alias("c0"))
    span = lambda c: F.explode(F.sequence(F.ceil(F.col(c) - F.col("radius")).cast("int"), F.floor(F.col(c) + F.col("radius")).cast("int")))
    hit = reach.withColumn("row", span("r0")).withColumn("col", span("c0"))
    hit = hit.where((F.pow(F.col("row") - F.col("r0"), 2) + F.pow(F.col("col") - F.col("c0"), 2)) <= F.pow("radius", 2))
    once = hit.select("area", "layer", "ring", "row", "col", "value").distinct()
    cost = cells.join(once.groupBy("area", "row", "col").agg(F.sum("value").alias("v")), ["area", "row", "col"], "left").withColumn("c", base + F.coalesce("v", F.lit(0.0)))
    return cost.select("area", "row", "col", (F.col("c") - F.min("c").over(Window.partitionBy("area")) + 1).alias("cost"))


def _search(cost: dict, start: tuple, goal: tuple) -> list[tuple]:
    best, came, heap, done = {start: 0.0}, {}, [(0.0, start)], set()
    while heap:
        d, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        if at == goal:
            break
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                to = (at[0] + dr, at[1] + dc)
                if to == at or to not in cost or to in done:
                    continue
                step = d + (cost[at] + cost[to]) / 2 * math.hypot(dr, dc)
                if step < best.get(to, math.inf):
                    best[to], came[to] = step, at
                    heapq.heappush(heap, (step, to))
    if goal not in best:
        return []
    path = [goal]
    while path[-1] != start:
        path.append(came[path[-1]])
    return path[::-1]


def routes(costs: DataFrame, ends: DataFrame, k: int = 3, penalty: float = 1.35, window: int = 5) -> DataFrame:
    """k routes for each area between its ends (r0, c0, r1, c1): area, route, seq,
    row, col, cost (of the unpenalised grid).  After each route the cells within
    ``window`` of every cell of it cost ``penalty`` times as much, again for each."""
    both = costs.join(ends, "area")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = {(int(r), int(c)): float(x) for r, c, x in zip(pdf["row"], pdf["col"], pdf["cost"])}
        cost = dict(base)
        first = pdf.iloc[0]
        start, goal = (int(first["r0"]), int(first["c0"])), (int(first["r1"]), int(first["c1"]))
        out = []
        for i in range(k):
            path = _search(cost, start, goal)
            out += [(first["area"], i, j, r, c, base[r, c]) for j, (r, c) in enumerate(path)]
            for r, c in path:
                for dr in range(-window, window + 1):
                    for dc in range(-window, window + 1):
                        if (r + dr, c + dc) in cost:
                            cost[r + dr, c + dc] *= penalty
        return pd.DataFrame(out, columns=["area", "route", "seq", "row", "col", "cost"])

    return both.groupBy("area").applyInPandas(run, "area long, route long, seq long, row long, col long, cost double")


def route_summary(route: DataFrame, cell_km: float = 0.3) -> DataFrame:
    w = Window.partitionBy("area", "route").orderBy("seq")
    step = F.sqrt(F.pow(F.col("row") - F.lag("row").over(w), 2) + F.pow(F.col("col") - F.lag("col").over(w), 2)) * cell_km
    return route.withColumn("step", step).groupBy("area", "route").agg(F.round(F.sum("step"), 6).alias("length_km"), F.round(F.avg("cost"), 6).alias("mean_resistance"), F.count("*").alias("cells"))
