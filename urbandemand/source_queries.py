"""Queries that go through files and other forms, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import driver_views as views
from .functions.curve import tile_number
from .functions.geo import tile_x, tile_y
from .operators import coverage, routing, sites
from .oracles import _COVER, _SITES
from .plans.demand import polygon_boxes
from .scratch import shared_dir
from .sinks.ordered import write_ordered
from .sources import osm
from .sources.json_array import read_array


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def array_document(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as one array of objects for each size, written in order by many tasks and read by many."""
    rows = spark.read.parquet(f"{sf}/part.parquet").withColumnRenamed("p_size", "size")
    at = _folder(spark, "arrays")
    write_ordered(rows, at, "size", ["p_partkey"], F.to_json(F.struct("p_partkey", F.concat("p_name", F.lit(' {"\\}')).alias("name"), F.array(F.struct("p_retailprice")).alias("prices"))))
    got = read_array(spark, f"{at}/*", "p_partkey long, name string, prices array<struct<p_retailprice:double>>", by_folder=True)
    return got.select(F.regexp_extract("document", r"size=(\d+)$", 1).cast("int").alias("size"), "ordinal", "p_partkey", "name", F.col("prices")[0]["p_retailprice"].alias("price"))


def staged_box(spark: SparkSession, sf: str) -> DataFrame:
    """Buildings staged along a curve, and those of a box read from there."""
    at = _folder(spark, "staged")
    none = F.lit(None).cast("double")
    osm.stage_elements(views.buildings(spark, sf).withColumn("lon", none).withColumn("lat", none), at)
    return osm.read_staged(spark, at, views.CITY, [-79.5, 43.6, -79.4, 43.7]).select("id")


def tile_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The tile of each site on the curve."""
    at = sites.select_sites(views.sites(spark, sf))
    z, x, y = F.lit(12), tile_x(F.col("lon"), 12), tile_y(F.col("lat"), 12)
    return at.select("place_id", x.cast("long").alias("x"), y.cast("long").alias("y"), tile_number(z, x, y, 12).alias("number"))


def _covers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Boxes of buildings, grown to many cells, and the grid's dimensions."""
    own = views.buildings(spark, sf).select("city", F.col("id").alias("polygon"), *(F.col(f"bounds.{b}").alias(e) for b, e in (("minlon", "west"), ("minlat", "south"), ("maxlon", "east"), ("maxlat", "north"))))
    dims = coverage.coverage_dims(coverage.union_box(own))
    more = F.when(F.col("polygon") % 7 == 0, 0.03).otherwise(0.0)
    return own.withColumns({"east": F.col("east") + more, "north": F.col("north") + more}), dims


def cover_squares(spark: SparkSession, sf: str) -> DataFrame:
    """Cells and squares of each box's cover, and whether its cells are those of the box."""
    boxes, dims = _covers(spark, sf)
    squares = coverage.cover(boxes, dims)
    cells = coverage.cover_cells(squares).groupBy("polygon").agg(F.count("*").alias("cells"), F.count_distinct("x", "y").alias("distinct_cells"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    both = cells.join(squares.groupBy("polygon").agg(F.count("*").alias("squares")), "polygon")
    return both.withColumn("few_squares", F.col("squares") <= 4 * (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0") + 2)).drop("squares")


def cover_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes that hold each site's cell."""
    boxes, dims = _covers(spark, sf)
    d = dims.select("city", F.col("west").alias("w"), F.col("south").alias("s"), "cell_x", "cell_y")
    cell = lambda c, low, size: F.floor((F.col(c) - F.col(low)) / F.col(size)).cast("int")
    at = sites.select_sites(views.sites(spark, sf)).join(d, "city").select("city", "place_id", cell("lon", "w", "cell_x").alias("x"), cell("lat", "s", "cell_y").alias("y"))
    return coverage.covering(at, coverage.cover(boxes, dims), 12).select("place_id", "polygon")


def water_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of polygons within a city, in order of features and parts."""
    ring = F.concat(F.lit("[[["), F.col("p_size").cast("string"), F.lit(",0],[1,1],[0,1],["), F.col("p_size").cast("string"), F.lit(",0]]]"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "MultiPolygon").otherwise("Polygon")
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("city"), F.col("p_partkey").alias("feature"), kind.alias("kind"), F.when(kind == "Polygon", ring).otherwise(F.concat(F.lit("["), ring, F.lit(","), ring, F.lit("]"))).alias("coordinates"))
    return polygon_boxes(rows).select("city", "polygon", "west", "east")


def routes_once(spark: SparkSession, sf: str) -> DataFrame:
    """How many requests of two runs were asked for in each, where the first had no route for some."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    name = lambda c: F.col(c).cast("string")
    asked = o.select(F.lit(views.CITY).alias("city"), name("o_custkey").alias("residence_id"), F.col("o_orderstatus").alias("job_id"), F.concat("o_orderstatus", name("o_custkey")).alias("request"), (F.col("o_orderkey") % 2 == 0).alias("early"))
    at = _folder(spark, "routes")
    route = lambda distance: F.array(F.struct(distance.cast("double").alias("distance"), F.lit(1.0).alias("duration"), F.from_json(F.lit("[]"), "array<struct<steps:array<struct<geometry:struct<coordinates:array<array<double>>>>>>>").alias("legs")))
    size = F.col("residence_id").cast("long")
    routing.routed_once(asked.filter("early"), at, lambda new: new.withColumn("routes", F.when(size % 5 != 0, route(size))))
    out = routing.routed_once(asked, at, lambda new: new.withColumn("routes", route(size)))
    return out.groupBy("version").agg(F.count("*").alias("n"), F.sum(F.col("routes")[0]["distance"]).alias("metres"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (array_document, staged_box, tile_numbers, cover_squares, cover_lookup, water_numbers, routes_once)}

_GROWN = f"""{_COVER.split(", box AS")[0]}, box AS (SELECT min(west) AS w0, min(south) AS s0, max(east) AS e0, max(north) AS n0 FROM b),
d AS (SELECT *, 0.0027E0 / cos((s0 + n0) / 2 * 3.141592653589793E0 / 180) AS cx, 0.0027E0 AS cy FROM box),
g AS (SELECT building_id AS polygon, w0, s0, cx, cy, greatest(0, floor((west - w0) / cx)) AS c0, least(ceil((e0 - w0) / cx) - 1, floor((east + CASE WHEN building_id % 7 = 0 THEN 0.03E0 ELSE 0.0E0 END - w0) / cx)) AS c1,
  greatest(0, floor((south - s0) / cy)) AS r0, least(ceil((n0 - s0) / cy) - 1, floor((north + CASE WHEN building_id % 7 = 0 THEN 0.03E0 ELSE 0.0E0 END - s0) / cy)) AS r1 FROM b, d)"""

ORACLE_SQL: dict[str, str] = {
    "array_document": """SELECT p_size::INT AS size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS ordinal, p_partkey, p_name || ' {"\\}' AS name, p_retailprice AS price FROM part""",
    "staged_box": f"WITH {_COVER.split(', box AS')[0]} SELECT building_id AS id FROM b WHERE east >= -79.5E0 AND west <= -79.4E0 AND north >= 43.6E0 AND south <= 43.7E0",
    "tile_numbers": f"""WITH RECURSIVE {_SITES}, t AS (SELECT place_id, floor((lon + 180) / 360 * 4096)::BIGINT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096)::BIGINT AS y FROM s),
q AS (SELECT place_id, x, y, x AS hx, y AS hy, 2048 AS side, 0::BIGINT AS d FROM t UNION ALL
 SELECT place_id, x, y, CASE WHEN hy & side = 0 THEN (CASE WHEN hx & side > 0 THEN side - 1 - (hy & (side - 1)) ELSE hy & (side - 1) END) ELSE hx & (side - 1) END,
  CASE WHEN hy & side = 0 THEN (CASE WHEN hx & side > 0 THEN side - 1 - (hx & (side - 1)) ELSE hx & (side - 1) END) ELSE hy & (side - 1) END, side // 2,
  d + side::BIGINT * side * xor(3 * (hx & side > 0)::INT, (hy & side > 0)::INT) FROM q WHERE side > 0)
SELECT place_id, x, y, d + (power(4, 12)::BIGINT - 1) // 3 AS number FROM q WHERE side = 0""",
    "cover_squares": f"WITH {_GROWN} SELECT polygon, ((c1 - c0 + 1) * (r1 - r0 + 1))::BIGINT AS cells, ((c1 - c0 + 1) * (r1 - r0 + 1))::BIGINT AS distinct_cells, c0::INT AS x0, c1::INT AS x1, r0::INT AS y0, r1::INT AS y1, true AS few_squares FROM g WHERE c1 >= c0 AND r1 >= r0",
    "cover_lookup": f"WITH {_SITES}, {_GROWN} SELECT place_id, polygon FROM s JOIN g ON floor((lon - w0) / cx) BETWEEN c0 AND c1 AND floor((lat - s0) / cy) BETWEEN r0 AND r1",
    "water_numbers": "WITH p AS (SELECT p_brand AS city, p_partkey AS feature, p_size, unnest(range(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END)) AS part FROM part) SELECT city, (row_number() OVER (PARTITION BY city ORDER BY feature, part) - 1)::INT AS polygon, least(0.0E0, p_size) AS west, greatest(1.0E0, p_size) AS east FROM p",
    "routes_once": """WITH a AS (SELECT o_custkey AS k, o_orderstatus AS s, bool_or(o_orderkey % 2 = 0) AS early FROM orders GROUP BY ALL)
SELECT CASE WHEN early AND k % 5 <> 0 THEN 1 ELSE 2 END::BIGINT AS version, count(*) AS n, sum(k)::DOUBLE AS metres FROM a GROUP BY 1""",
}
