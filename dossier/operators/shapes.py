"""Polygons, lines and points as rows, with buffers, joined to places on grid cells.

A shape (rings of points, closed or not, and a buffer) is covered by cells of a grid.
Cells that its outline, widened by the buffer, may touch are border cells; of the
others those inside a ring are inner cells.  A place in an inner cell is inside
without a test, as it is in a border cell that lies within the buffer of one edge as a
whole.  Elsewhere in border cells two tests follow on equal keys: the distance to the
edges that touch the cell, and how many edges of the cell's row lie to the right of the
place.  Rings of one shape count together, so a ring inside another is a hole.  The
outline itself belongs to the shape.

Nothing is collected but the crossings of one shape with one row of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

#: Cells reach a little further than numbers say, as quotients are rounded.
MARGIN = 1e-9
#: Spark takes cells for as few as the shapes that they were made of, and would broadcast
#: them from the driver; joins with cells shuffle.
APART = "merge"
# Fixed value: what a layer adds that a route must not cross.
FORBIDDEN = 14000.0


def edges(shapes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """shape_id, closed, buffer, x1, y1, x2, y2 of every edge of the shapes (shape_id,
    closed, buffer, rings array<array<struct<x,y>>>), with the columns ``by``.  A ring of one point is an edge
    without length; empty and null rings have none."""
    ring = shapes.select("shape_id", *by, "closed", F.coalesce("buffer", F.lit(0.0)).alias("buffer"), F.explode("rings").alias("ring"))
    nxt = F.when(F.col("closed") | (F.size("ring") == 1), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))).otherwise(F.slice("ring", 2, F.size("ring")))
    first = F.slice("ring", F.lit(1), F.size(nxt))
    edge = ring.where(F.size("ring") > 0).select("shape_id", *by, "closed", "buffer", F.explode(F.arrays_zip(first.alias("a"), nxt.alias("b"))).alias("e"))
    return edge.select("shape_id", *by, "closed", "buffer", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def _span(low: Column, high: Column, size: float) -> Column:
    """The cells from one coordinate to another."""
    return F.sequence(F.floor(low / size - MARGIN).cast("int"), F.floor(high / size + MARGIN).cast("int"))


def square_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a place to an edge, squared."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def touched(edge: DataFrame, size: float) -> DataFrame:
    """Edges with each cell (cx, cy) that they, widened by the buffer, may touch: for
    every column the part of the edge that is near it says which rows."""
    b = F.col("buffer")
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    rows = edge.select("*", F.explode(_span(left - b, right + b, size)).alias("cx"))
    # where the edge enters and leaves the widened column, as parts of its length
    part = lambda x: F.when(F.col("x1") == F.col("x2"), 0.0).otherwise((x - F.col("x1")) / (F.col("x2") - F.col("x1")))
    inside = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    low, high = F.col("cx") * size - b, (F.col("cx") + 1) * size + b
    at = lambda t: F.col("y1") + inside(t) * (F.col("y2") - F.col("y1"))
    upright = F.col("x1") == F.col("x2")
    ya = F.when(upright, F.col("y1")).otherwise(at(part(low)))
    yb = F.when(upright, F.col("y2")).otherwise(at(part(high)))
    return rows.select("*", F.explode(_span(F.least(ya, yb) - b, F.greatest(ya, yb) + b, size)).alias("cy"))


def cover(shapes: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """shape_id, by, cx, cy and sure (whether all places of the cell are inside)."""
    edge = edges(shapes, by)
    near = touched(edge, size)
    corner = lambda i, j: square_distance((F.col("cx") + i) * size, (F.col("cy") + j) * size, *(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    reach = F.col("buffer") * (1 - MARGIN)
    whole = F.greatest(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)) < reach * reach
    border = near.groupBy("shape_id", *by, "cx", "cy").agg(F.bool_or(whole).alias("sure"))
    # along the middle of each row, between an odd crossing and the next
    ring = edge.where("closed").select("*", F.explode(_span(F.least("y1", "y2"), F.greatest("y1", "y2"), size)).alias("cy"))
    middle = (F.col("cy") + 0.5) * size
    ring = ring.where((F.col("y1") > middle) != (F.col("y2") > middle))
    crossing = (F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    xs = ring.groupBy("shape_id", *by, "cy").agg(F.array_sort(F.collect_list(crossing)).alias("xs"))
    pair = F.explode(F.expr("transform(sequence(0, size(xs) - 2, 2), i -> struct(xs[i] AS a, xs[i + 1] AS b))")).alias("p")
    span = xs.where(F.size("xs") > 1).select("shape_id", *by, "cy", pair)
    first, last = F.ceil(F.col("p.a") / size - 0.5).cast("int"), F.floor(F.col("p.b") / size - 0.5).cast("int")
    inner = span.where(first <= last).select("shape_id", *by, F.explode(F.sequence(first, last)).alias("cx"), "cy").distinct()
    inner = inner.join(border.hint(APART), ["shape_id", "cx", "cy"], "left_anti")
    return border.unionByName(inner.withColumn("sure", F.lit(True)))


def inside(places: DataFrame, shapes: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """place_id and shape_id of each place (place_id, x, y) inside a shape or within its
    buffer, where they agree in the columns ``by``.  Places with a null coordinate are
    nowhere."""
    at = _at(places, size, by)
    met = cut(at.join(cover(shapes, size, by).hint(APART), [*by, "cx", "cy"]))
    pair = ["place_id", "shape_id"]
    return met.where("sure").select(*pair).unionByName(_tested(met.where("NOT sure").drop("sure"), shapes, size)).distinct()


def _at(places: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    return places.select("place_id", *by, "x", "y", F.floor(F.col("x") / size).cast("int").alias("cx"), F.floor(F.col("y") / size).cast("int").alias("cy"))


def _tested(rest: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """place_id and shape_id, once, of the places (place_id, x, y, cx, cy, shape_id) in
    border cells of a shape that are in it or within its buffer."""
    edge = edges(shapes)
    spot = [F.col("x"), F.col("y")]
    near = rest.join(touched(edge, size).hint(APART), ["shape_id", "cx", "cy"])
    near = near.where(square_distance(*spot, *(F.col(c) for c in ("x1", "y1", "x2", "y2"))) <= F.col("buffer") * F.col("buffer"))
    row = edge.where("closed AND y1 <> y2").select("shape_id", "x1", "y1", "x2", "y2", F.explode(_span(F.least("y1", "y2"), F.greatest("y1", "y2"), size)).alias("cy"))
    cast = rest.join(row.hint(APART), ["shape_id", "cy"]).where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    right = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    odd = cast.where(right).groupBy("place_id", "shape_id").agg(F.count("*").alias("n")).where("n % 2 = 1")
    pair = ["place_id", "shape_id"]
    return near.select(*pair).unionByName(odd.select(*pair)).distinct()


def kinds_inside(places: DataFrame, shapes: DataFrame, size: float, kind: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """place_id and the fields ``kind`` of shape_id, once, of the shapes that a place is
    inside, as ``inside`` has them.  Where one shape of a kind holds a cell as a whole,
    no other of the kind is met there."""
    covered = cut(cover(shapes, size, by)).select("*", *(f"shape_id.{k}" for k in kind))
    at = cut(_at(places, size, by))
    key = [*by, "cx", "cy"]
    sure = covered.where("sure").select(*key, *kind).distinct()
    rest = covered.where("NOT sure").join(sure.hint(APART), [*key, *kind], "left_anti").select("shape_id", *key)
    rest = cut(at.join(rest.hint(APART), key))
    tested = _tested(rest, shapes, size).select("place_id", *(f"shape_id.{k}" for k in kind))
    return at.join(sure.hint(APART), key).select("place_id", *kind).unionByName(tested).distinct()


def counted(places: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """place_id, the first (least) shape_id and how many shapes a place is inside, as
    ``inside`` has them; null and 0 where it is in none.  Inner cells count their shapes
    once for all places, and places of one spot are tested once."""
    spots = places.where("x IS NOT NULL AND y IS NOT NULL").select(F.struct("x", "y").alias("place_id"), "x", "y").distinct()
    covered = cut(cover(shapes, size))
    figures = lambda rows, *key: rows.groupBy(*key).agg(F.min("shape_id").alias("first"), F.count("*").alias("n"))
    at = cut(_at(spots, size))
    sure = at.join(figures(covered.where("sure"), "cx", "cy"), ["cx", "cy"]).select("place_id", "first", "n")
    rest = cut(at.join(covered.where("NOT sure").drop("sure").hint(APART), ["cx", "cy"]))
    both = sure.unionByName(figures(_tested(rest, shapes, size), "place_id"))
    found = both.groupBy("place_id").agg(F.min("first").alias("first"), F.sum("n").alias("n")).select(F.col("place_id.x").alias("x"), F.col("place_id.y").alias("y"), "first", "n")
    return places.select("place_id", "x", "y").join(found.hint(APART), ["x", "y"], "left").select("place_id", "first", F.coalesce("n", F.lit(0)).alias("n"))


def first_inside(places: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """place_id and the name of the first shape (by ord) that a place is in; null where
    it is in none."""
    named = inside(places, shapes, size).join(shapes.select("shape_id", "ord", "name"), "shape_id")
    best = named.groupBy("place_id").agg(F.min_by("name", "ord").alias("name"))
    return places.select("place_id").join(best, "place_id", "left")


def rings_of(layers: DataFrame, weights: DataFrame) -> DataFrame:
    """layer, ring, buffer and value of each layer (layer, categories array<string>,
    resistance string, ring_m, rings array<struct<buffer, resistance>>): the shape
    itself is ring 0.  A layer's weight is the sum of its categories'; resistance FB
    forbids, without a weight and as far as ring_m."""
    weight = layers.select("layer", F.explode("categories").alias("category")).join(weights, "category").groupBy("layer").agg(F.sum("weight").alias("weight"))
    spec = layers.join(weight, "layer", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    fb = F.col("resistance") == "FB"
    own = spec.select("layer", F.lit(0).alias("ring"), F.when(fb, F.coalesce("ring_m", F.lit(0.0))).otherwise(0.0).alias("buffer"), F.when(fb, FORBIDDEN).otherwise(F.expr("try_cast(resistance AS double)") * F.col("weight")).alias("value"))
    more = spec.select("layer", "weight", F.posexplode("rings").alias("at", "r"))
    return own.unionByName(more.select("layer", (F.col("at") + 1).alias("ring"), F.col("r.buffer").alias("buffer"), (F.col("r.resistance") * F.col("weight")).alias("value")))


def burn(cells: DataFrame, shapes: DataFrame, rings: DataFrame, cell: float, join: int = 8) -> DataFrame:
    """The cost of each cell (area, row, col), whose centre is half a ``cell`` further:
    the value of every ring (layer, ring, buffer, value) in which its centre lies, once
    however many shapes (area, shape_id, layer, closed, rings) of the layer say so,
    shifted so that an area's least is 1.  Shapes of an area meet its cells only, on a
    grid ``join`` times as wide; the result doesn't depend on it."""
    places = cells.select(F.struct("area", "row", "col").alias("place_id"), ((F.col("col") + 0.5) * cell).alias("x"), ((F.col("row") + 0.5) * cell).alias("y"), "area")
    wide = shapes.select("area", "layer", "closed", "rings", "shape_id").join(rings.select("layer", "ring", "buffer"), "layer").withColumn("shape_id", F.struct("shape_id", "layer", "ring"))
    hit = kinds_inside(places, wide, cell * join, ("layer", "ring"), ("area",))
    total = hit.join(rings.select("layer", "ring", "value"), ["layer", "ring"]).groupBy("place_id").agg(F.sum("value").alias("value"))
    cost = places.join(total, "place_id", "left").select("place_id.*", F.coalesce("value", F.lit(0.0)).alias("cost"))
    least = cost.groupBy("area").agg(F.min("cost").alias("least"))
    return cost.join(least, "area").select("area", "row", "col", (F.col("cost") - F.col("least") + 1.0).alias("cost"))
