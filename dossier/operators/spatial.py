"""Spatial joins on a grid of cells, and the gazetteer cascade.

A pair within a margin lies in the same cell or in cells that the margin's
envelope covers, so joins are equi-joins on cells with an exact residual.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import envelope, haversine_km, reach
from ..plans.cut import cut


def _cell(x, size: float):
    return F.floor(x / size).cast("int")


def _column(lon, size: float):
    """The column of cells of a meridian, counted from 0 once around the earth."""
    return F.floor(F.pmod(lon, F.lit(360.0)) / size).cast("int")


def _reached(rows: DataFrame, lon, lat, km, size: float) -> DataFrame:
    """Rows with each cell (cx, cy) that holds places within km of theirs."""
    w, s, e, n = reach(lon, lat, km)
    last = F.lit(math.ceil(360 / size) - 1)
    west, east = _column(w, size), _column(e, size)
    # from west to east, past the end of the turn where that comes between
    columns = F.when(e - w >= 360 - size, F.sequence(F.lit(0), last)).when(west <= east, F.sequence(west, east)).otherwise(F.concat(F.sequence(west, last), F.sequence(F.lit(0), east)))
    known = rows.where(lon.isNotNull() & lat.isNotNull() & km.isNotNull())
    return known.select("*", columns.alias("__xs"), F.sequence(_cell(s, size), _cell(n, size)).alias("__ys")).select("*", F.explode("__xs").alias("cx")).select("*", F.explode("__ys").alias("cy")).drop("__xs", "__ys")


def envelope_hits(points: DataFrame, layer: DataFrame, metres: float, cell: float = 1.0) -> DataFrame:
    """Points (point_id, lon, lat) and layer points (hit_id, lon, lat) inside the
    envelope of each point."""
    w, s, e, n = envelope(F.col("lon"), F.col("lat"), metres)
    p = points.select("point_id", w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))
    p = p.select("*", F.explode(F.sequence(_cell(F.col("w"), cell), _cell(F.col("e"), cell))).alias("cx")).select("*", F.explode(F.sequence(_cell(F.col("s"), cell), _cell(F.col("n"), cell))).alias("cy"))
    q = layer.select("hit_id", F.col("lon").alias("x"), F.col("lat").alias("y")).withColumn("cx", _cell(F.col("x"), cell)).withColumn("cy", _cell(F.col("y"), cell))
    return p.join(q, ["cx", "cy"]).where("x between w and e and y between s and n").select("point_id", "hit_id")


def within(a: DataFrame, b: DataFrame, km: float, cell: float = 1.0) -> DataFrame:
    """Pairs (point_id, hit_id, km) no further apart than km."""
    p = _reached(a.select("point_id", "lon", "lat"), F.col("lon"), F.col("lat"), F.lit(float(km)), cell)
    q = b.select("hit_id", F.col("lon").alias("x"), F.col("lat").alias("y"), _column(F.col("lon"), cell).alias("cx"), _cell(F.col("lat"), cell).alias("cy"))
    j = p.join(q, ["cx", "cy"])
    d = haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    return j.withColumn("km", d).where(F.col("km") <= km).select("point_id", "hit_id", F.round("km", 6).alias("km"))


def path_length(points: DataFrame, key: str, order: str) -> DataFrame:
    """The sum of the distances between consecutive points of each path."""
    w = Window.partitionBy(key).orderBy(order)
    d = haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return points.withColumn("d", d).groupBy(key).agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 6).alias("km"), F.count("*").alias("points"))


def candidates(names: DataFrame, gazetteer_stop: tuple[str, ...] = (), heads: DataFrame | None = None) -> DataFrame:
    """id, place, tier and at: the place names a row could mean, best tier first:
    its municipality, the name's runs of 4, 3 and 2 words, single words of 6
    letters or more.  With ``heads`` (head, admin1: first words of known places) runs
    that begin otherwise are left out before anything is shuffled."""
    words = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda t: t != "")
    n = names.withColumn("w", words)
    town = F.when(F.coalesce("municipality", F.lit("")) != "", F.array(F.lower("municipality"))).otherwise(F.array().cast("array<string>"))
    single = F.filter("w", lambda t: (F.length(t) >= 6) & (~t.isin(*gazetteer_stop) if gazetteer_stop else F.lit(True)))
    if heads is not None:
        spots = n.where(F.size("w") > 0).select("id", "admin1", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, F.lit(4)))).alias("at", "s"))
        near = spots.join(heads.select(F.col("head"), F.col("admin1").alias("of")), (F.col("s")[0] == F.col("head")) & (F.col("admin1") == F.col("of")))
        run = lambda k: F.when(F.size("s") >= k, F.array_join(F.slice("s", 1, k), " "))
        alone = F.when((F.length("head") >= 6) & (~F.col("head").isin(*gazetteer_stop) if gazetteer_stop else F.lit(True)), F.col("head"))
        made = F.array(*(F.struct(F.lit(tier).alias("tier"), place.alias("place")) for tier, place in enumerate((run(4), run(3), run(2), alone), 1)))
        runs = near.select("id", "admin1", "at", F.explode(made).alias("x")).select("id", "admin1", "x.tier", "at", "x.place").where("place IS NOT NULL")
        return n.select("id", "admin1", F.lit(0).alias("tier"), F.posexplode(town).alias("at", "place")).unionByName(runs)
    tiers = [town, *(T.ngrams(F.col("w"), k) for k in (4, 3, 2)), single]
    parts = [n.select("id", "admin1", F.lit(i).alias("tier"), F.posexplode(t).alias("at", "place")) for i, t in enumerate(tiers)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def geocode(names: DataFrame, gazetteer: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """Each row's first place in the gazetteer (place, admin1, lat, lon): id, place,
    tier (how it was found), lat, lon.  Rows without one are left out."""
    # written, so that Spark knows how few they are and need not shuffle every word
    heads = cut(gazetteer.select(F.split("place", " ")[0].alias("head"), "admin1").distinct())
    hit = candidates(names, stop, heads).join(gazetteer, ["place", "admin1"])
    first = F.struct("tier", "at")
    return hit.groupBy("id").agg(F.min_by(F.struct("place", "tier", "lat", "lon"), first).alias("b")).select("id", "b.place", "b.tier", "b.lat", "b.lon")


def in_polygon(points: DataFrame, rings: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """The name of the polygon, if any, each point (lon, lat) lies in, by ray casting."""

    @F.pandas_udf("string")
    def inside(lon: pd.Series, lat: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(lon), index=lon.index, dtype=object)
        for name, ring in rings.items():
            odd = pd.Series(False, index=lon.index)
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
                if y1 != y2:
                    odd ^= ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            out[odd & out.isna()] = name
        return out

    return points.withColumn("polygon", inside("lon", "lat"))


def triggered(points: DataFrame, features: DataFrame, rules: DataFrame, cell: float = 1.0) -> DataFrame:
    """point_id, discipline and how many features trigger it: those of a kind that a
    rule (kind, km, discipline) names and within the rule's distance.  Features
    meet points on the cells that each rule's distance reaches."""
    fires = features.join(rules, "kind").select(F.col("lon").alias("x"), F.col("lat").alias("y"), "km", "discipline")
    wide = _reached(fires, F.col("x"), F.col("y"), F.col("km"), cell)
    p = points.withColumn("cx", _column(F.col("lon"), cell)).withColumn("cy", _cell(F.col("lat"), cell))
    near = p.join(wide, ["cx", "cy"]).where(haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) <= F.col("km"))
    return near.groupBy("point_id", "discipline").agg(F.count("*").alias("features"))
