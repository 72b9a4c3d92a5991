"""Road, runway and ocean features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buffer import buffer_metres
from ..functions.geo import closed, ring_area, unmercator_lat, unmercator_lon
from ..functions.text import street_name
from ..lookups import AEROWAYS, ROAD_CLASS, looked_up
from ..params import DEFAULTS, Params


def line_of(points: Column) -> Column:
    """Points as lon-lat pairs."""
    return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))


def road_features(elements: DataFrame, params: Params = DEFAULTS, kept: tuple[str, ...] = ()) -> DataFrame:
    """Ways of the highway kinds that are read, as line features; ``kept`` are columns that stay."""
    highway = F.col("tags")["highway"]
    rows = elements.filter((F.col("type") == "way") & highway.isin(*ROAD_CLASS))
    return rows.select("city", "id", *kept, looked_up(ROAD_CLASS, highway).alias("road_class"), F.lit("normal").alias("structure"), street_name(F.col("tags"), params.locale).alias("name"), line_of(F.col("geometry")).alias("coordinates"))


def runway_properties(elements: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Properties of runway features: lines have a z-order, areas their kind and size.

    Rows are dealt evenly over as many tasks as a shuffle has, as what lies
    around a line takes some tenths of a millisecond to find and a file of many
    elements may be one task's.
    """
    tasks = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = F.col("tags")["aeroway"]
    line = kind.isin("runway", "taxiway")
    rows = elements.filter((F.col("type") == "way") & kind.isin(*AEROWAYS)).repartition(tasks).withColumn("ring", closed(F.col("geometry")))
    return rows.select(
        "city", "id", *kept, F.lit("runway").alias("road_type"), F.when(line, F.lit(0)).alias("z_order"), F.when(~line, kind).alias("aeroway"), F.col("id").cast("string").alias("osm_way_id"),
        F.when(line, F.lit(0.0)).otherwise(ring_area(F.col("ring"))).alias("area"), F.when(kind == "runway", F.lit(30.0)).when(kind == "taxiway", F.lit(10.0)).alias("buffer_m"), "geometry",
    )


def runway_features(elements: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Runway features as JSON coordinates: an area with its own ring, a line with the outer ring of what lies around it."""
    rows = runway_properties(elements, kept)
    line = line_of(F.col("geometry"))
    ring = F.when(F.col("buffer_m").isNull(), line).otherwise(F.get(F.get(buffer_metres(F.array(line), F.col("buffer_m")), F.lit(0)), F.lit(0)))
    return rows.select("city", "id", *kept, "road_type", "z_order", "aeroway", "osm_way_id", "area", F.lit("Polygon").alias("kind"), F.to_json(F.array(F.coalesce(ring, F.slice(line, 1, 0)))).alias("coordinates"))


def ocean_ring(rings: Column) -> Column:
    """Rings in degrees: web-map metres are turned back where the first point is out of range."""
    metres = F.abs(rings[0][0][0]) > 180
    return F.when(metres, F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(unmercator_lon(p[0]), unmercator_lat(p[1]))))).otherwise(rings)


def ocean_features(depths: DataFrame) -> DataFrame:
    """``city, depth_min, coordinates`` of a coverage index's polygons."""
    return depths.select("city", F.col("depth").alias("depth_min"), ocean_ring(F.col("rings")).alias("coordinates"))
