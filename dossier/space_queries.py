"""Registered queries of shapes, cost surfaces and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import shapes, tiles
from .plans.tables import lonlat, table
from .queries import query

#: Corners of a supplier's grounds around its place, not convex, in whole parts of its size.
_CORNERS = ((4, 0), (1, 1), (0, 4), (-3, 3), (-1, 0), (-2, -3), (1, -1))


def _places(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    x, y = lonlat(F.col(key))
    return table(spark, d, name).withColumn("x", x).withColumn("y", y)


def _grounds(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with a polygon around their place: rings, and size."""
    size = (F.col("s_suppkey") % 5 + 1) * 0.25
    corner = lambda i, j: F.struct((F.col("x") + i * size).alias("x"), (F.col("y") + j * size).alias("y"))
    return _places(spark, d, "supplier", "s_suppkey").withColumn("rings", F.array(F.array(*(corner(*c) for c in _CORNERS))))


# A supplier's corners in order, and its edges; squared distance of (x, y) to an edge.
_SQL_PLACE = "-140.0 + ({0} * 7919) % 8700 / 100.0 AS x, 42.0 + ({0} * 104729) % 4100 / 100.0 AS y"
_SQL_CORNERS = ", ".join(f"({n}, {i}, {j})" for n, (i, j) in enumerate(_CORNERS))
_SQL_GROUNDS = f"""sp AS (SELECT s_suppkey AS k, s_nationkey AS nk, (s_suppkey % 5 + 1) * 0.25 AS size, {_SQL_PLACE.format('s_suppkey')} FROM supplier),
pt AS (SELECT k, n, sp.x + i * size AS px, sp.y + j * size AS py FROM sp, (VALUES {_SQL_CORNERS}) c(n, i, j)),
ge AS (SELECT a.k, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM pt a JOIN pt b ON a.k = b.k AND b.n = (a.n + 1) % {len(_CORNERS)})"""
_SQL_D2 = """CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > 0 THEN greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0.0 END"""
_SQL_NEAR = "(x - (x1 + t * (x2 - x1))) * (x - (x1 + t * (x2 - x1))) + (y - (y1 + t * (y2 - y1))) * (y - (y1 + t * (y2 - y1)))"
_SQL_CROSS = "(y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END) + x1"


@query(f"""WITH {_SQL_GROUNDS}, c AS (SELECT c_custkey, {_SQL_PLACE.format('c_custkey')} FROM customer),
m AS (SELECT c_custkey, k, x, y, x1, y1, x2, y2, {_SQL_D2} AS t, (k % 3) * 0.3 AS b FROM c, ge),
h AS (SELECT c_custkey, k FROM m GROUP BY 1, 2 HAVING bool_or({_SQL_NEAR} <= b * b) OR count(*) FILTER ({_SQL_CROSS}) % 2 = 1)
SELECT c.c_custkey, min(k) AS first_ground, count(k) AS grounds FROM c LEFT JOIN h USING (c_custkey) GROUP BY 1""")
def buffered_grounds(spark: SparkSession, d: str) -> DataFrame:
    """In how many suppliers' grounds, buffered, a customer lies, and the first of them."""
    g = _grounds(spark, d).select(F.col("s_suppkey").alias("shape_id"), F.lit(True).alias("closed"), ((F.col("s_suppkey") % 3) * 0.3).alias("buffer"), "rings", F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("name"))
    c = _places(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("place_id"), "x", "y")
    n = shapes.counted(c, g, 0.5)
    return n.select(F.col("place_id").alias("c_custkey"), F.col("first").alias("first_ground"), F.col("n").alias("grounds"))


_CELL = 0.5
_WEIGHTS = [("nature", 0.4), ("people", 0.35), ("cost", 0.25)]
_LAYERS = [("ground", ["nature", "people"], "3", None, [(0.5, 2.0), (1.0, 1.0)]), ("path", ["cost"], "-4", None, [(0.4, -2.0)]), ("post", ["people"], "FB", 0.3, [])]


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("area"))


def customer_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every cell in which a customer of a region lies, and its neighbours."""
    c = _places(spark, d, "customer", "c_custkey").join(_regions(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    near = F.sequence(F.lit(-1), F.lit(1))
    cells = c.select("area", F.floor(F.col("y") / _CELL).alias("r0"), F.floor(F.col("x") / _CELL).alias("c0")).distinct()
    cells = cells.select("area", "r0", "c0", F.explode(near).alias("dr")).select("area", "r0", "c0", "dr", F.explode(near).alias("dc"))
    return cells.select("area", (F.col("r0") + F.col("dr")).cast("int").alias("row"), (F.col("c0") + F.col("dc")).cast("int").alias("col")).distinct()


def burned(spark: SparkSession, d: str, cells: DataFrame, cell: float, join: int = 8) -> DataFrame:
    """The cost of cells by three layers: suppliers' grounds with two rings, the lines
    through the suppliers of each nation, and forbidden posts at every tenth supplier."""
    nation = _regions(spark, d)
    s = _grounds(spark, d).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    spot = F.struct("x", "y")
    ground = s.select("area", F.col("s_suppkey").cast("long").alias("shape_id"), F.lit("ground").alias("layer"), F.lit(True).alias("closed"), "rings")
    path = s.groupBy("area", F.col("s_nationkey").cast("long").alias("shape_id")).agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("rings"))
    path = path.select("area", "shape_id", F.lit("path").alias("layer"), F.lit(False).alias("closed"), "rings")
    post = s.where("s_suppkey % 10 = 0").select("area", F.col("s_suppkey").cast("long").alias("shape_id"), F.lit("post").alias("layer"), F.lit(False).alias("closed"), F.array(F.array(spot)).alias("rings"))
    layers = spark.createDataFrame(_LAYERS, "layer string, categories array<string>, resistance string, ring_m double, rings array<struct<buffer:double,resistance:double>>")
    weights = spark.createDataFrame(_WEIGHTS, "category string, weight double")
    return shapes.burn(cells, ground.unionByName(path).unionByName(post), shapes.rings_of(layers, weights), cell, join)


_SQL_RINGS = "(VALUES ('ground', 0, 0.0, 3.0 * (0.4 + 0.35)), ('ground', 1, 0.5, 2.0 * (0.4 + 0.35)), ('ground', 2, 1.0, 1.0 * (0.4 + 0.35)), ('path', 0, 0.0, -4.0 * 0.25), ('path', 1, 0.4, -2.0 * 0.25), ('post', 0, 0.3, 14000.0)) r(layer, ring, b, value)"


@query(f"""WITH {_SQL_GROUNDS}, na AS (SELECT n_nationkey, n_regionkey AS area FROM nation),
cp AS (SELECT n_regionkey AS area, {_SQL_PLACE.format('c_custkey')} FROM customer JOIN nation ON n_nationkey = c_nationkey),
cc AS (SELECT DISTINCT area, CAST(floor(y / {_CELL}) AS INT) + dr AS "row", CAST(floor(x / {_CELL}) AS INT) + dc AS col FROM cp, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)),
ce AS (SELECT *, ("row" + 0.5) * {_CELL} AS y, (col + 0.5) * {_CELL} AS x FROM cc),
pa AS (SELECT nk, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY nk) AS n FROM sp WINDOW w AS (PARTITION BY nk ORDER BY k)),
e AS (SELECT area, 'ground' AS layer, k AS shape, true AS closed, x1, y1, x2, y2 FROM ge JOIN sp USING (k) JOIN na ON n_nationkey = nk
  UNION ALL SELECT area, 'path', nk, false, x1, y1, coalesce(x2, x1), coalesce(y2, y1) FROM pa JOIN na ON n_nationkey = nk WHERE x2 IS NOT NULL OR n = 1
  UNION ALL SELECT area, 'post', k, false, x, y, x, y FROM sp JOIN na ON n_nationkey = nk WHERE k % 10 = 0),
m AS (SELECT ce.area, "row", col, x, y, e.* EXCLUDE (area), {_SQL_D2} AS t FROM ce JOIN e ON e.area = ce.area),
h AS (SELECT area, "row", col, layer, shape, min({_SQL_NEAR}) AS d2, any_value(closed) AND count(*) FILTER ({_SQL_CROSS}) % 2 = 1 AS odd FROM m GROUP BY 1, 2, 3, 4, 5),
v AS (SELECT DISTINCT area, "row", col, h.layer, ring, value FROM h JOIN {_SQL_RINGS} ON r.layer = h.layer WHERE odd OR d2 <= b * b),
s AS (SELECT area, "row", col, sum(value) AS value FROM v GROUP BY 1, 2, 3),
c AS (SELECT cc.*, coalesce(value, 0.0) AS cost FROM cc LEFT JOIN s USING (area, "row", col))
SELECT CAST(area AS BIGINT) AS area, "row", col, round(CAST(cost AS DOUBLE) - min(CAST(cost AS DOUBLE)) OVER (PARTITION BY area) + 1, 6) AS cost FROM c""")
def shape_cost_surface(spark: SparkSession, d: str) -> DataFrame:
    return burned(spark, d, customer_cells(spark, d), _CELL).withColumn("cost", F.round("cost", 6))


@query()
def burned_routes(spark: SparkSession, d: str) -> DataFrame:
    """A route across each region's grid, burned by the layers, from its first
    supplier to its last, over tiles."""
    size = 2.0
    s = _places(spark, d, "supplier", "s_suppkey").join(_regions(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("area", "s_suppkey", F.floor(F.col("y") / size).alias("row"), F.floor(F.col("x") / size).alias("col"))
    span = lambda c: F.explode(F.sequence(F.col(f"{c}_low"), F.col(f"{c}_high"))).alias(c)
    box = s.groupBy("area").agg(*(f(c).alias(f"{c}_{n}") for c in ("row", "col") for f, n in ((F.min, "low"), (F.max, "high"))))
    cells = box.select("area", span("row"), "col_low", "col_high").select("area", "row", span("col"))
    first, last = (f(F.struct("row", "col"), "s_suppkey").alias(n) for f, n in ((F.min_by, "a"), (F.max_by, "b")))
    ends = s.groupBy("area").agg(first, last).select("area", F.col("a.row").alias("r0"), F.col("a.col").alias("c0"), F.col("b.row").alias("r1"), F.col("b.col").alias("c1"))
    # a wider grid than the cells' would test every shape with all cells around it
    return tiles.routes(burned(spark, d, cells, size, join=1), ends, k=1, tile=32)
