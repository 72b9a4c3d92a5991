"""Sites and buildings derived from the driver's tables, which hold no geometry.

Integer arithmetic and single roundings only, so every engine makes the same
numbers. The SQL is also the head of the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITY = "YYZ"
BBOX = [-79.67, 43.57, -79.23, 43.78]

SITES_SQL = """select s_suppkey as place_id,
 -79.67E0 + (s_suppkey * 7919 % 10007) / 10007.0E0 * 0.44E0 as lon, 43.57E0 + (s_suppkey * 104729 % 10009) / 10009.0E0 * 0.21E0 as lat,
 case when s_suppkey % 20 = 0 then 'terminal' when s_suppkey % 20 = 1 then 'university' when s_suppkey % 2 = 0 then 'quarter' else 'neighbourhood' end as kind,
 s_name as name from supplier"""

BUILDINGS_SQL = """select p_partkey as building_id,
 -79.67E0 + (p_partkey * 6007 % 10037) / 10037.0E0 * 0.44E0 as lon, 43.57E0 + (p_partkey * 5003 % 10039) / 10039.0E0 * 0.21E0 as lat,
 0.0003E0 + (p_size % 10) * 0.0001E0 as w, 0.0002E0 + (p_partkey % 7) * 0.0001E0 as h,
 case p_partkey % 12 when 0 then 'apartments' when 1 then 'house' when 2 then 'residential' when 3 then 'detached' when 4 then 'office' when 5 then 'retail'
  when 6 then 'school' when 7 then 'hospital' when 8 then 'industrial' when 9 then 'university' when 10 then 'shed' else 'garage' end as btype,
 case when p_partkey % 11 = 0 then null when p_partkey % 11 = 1 then '3;4' else cast(p_size % 40 + 1 as string) end as levels,
 case when p_partkey % 5 = 0 then cast(p_size % 4 as string) when p_partkey % 5 = 1 then 'x' end as underground,
 case when p_partkey % 60 = 4 then 'terminal' end as aeroway, p_name as name from part"""


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {table}", "from {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites as elements: the even ones nodes, the others ways with bounds around the place."""
    s = _view(spark, sf_dir, "supplier", SITES_SQL)
    node = F.col("place_id") % 2 == 0
    bounds = F.struct((F.col("lat") - 0.0).alias("minlat"), (F.col("lon") - 0.0).alias("minlon"), F.col("lat").alias("maxlat"), F.col("lon").alias("maxlon"))
    key = F.when(F.col("kind") == "terminal", "aeroway").when(F.col("kind") == "university", "amenity").otherwise("place")
    return s.select(
        F.lit(CITY).alias("city"), F.col("place_id").alias("ordinal"), F.when(node, "node").otherwise("way").alias("type"), F.col("place_id").alias("id"),
        F.when(node, F.col("lat")).alias("lat"), F.when(node, F.col("lon")).alias("lon"), F.when(~node, bounds).alias("bounds"), F.create_map(key, F.col("kind"), F.lit("name"), F.col("name")).alias("tags"),
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings as way elements with an open ring of four points."""
    b = _view(spark, sf_dir, "part", BUILDINGS_SQL)
    west, east, south, north = F.col("lon") - F.col("w") / 2, F.col("lon") + F.col("w") / 2, F.col("lat") - F.col("h") / 2, F.col("lat") + F.col("h") / 2
    corner = lambda lon, lat: F.struct(lat.alias("lat"), lon.alias("lon"))
    tags = F.map_filter(F.create_map(F.lit("building"), F.col("btype"), F.lit("building:levels"), F.col("levels"), F.lit("building:levels:underground"), F.col("underground"), F.lit("aeroway"), F.col("aeroway"), F.lit("name"), F.col("name")), lambda _, v: v.isNotNull())
    return b.select(
        F.lit(CITY).alias("city"), F.col("building_id").alias("ordinal"), F.lit("way").alias("type"), F.col("building_id").alias("id"),
        F.struct(south.alias("minlat"), west.alias("minlon"), north.alias("maxlat"), east.alias("maxlon")).alias("bounds"),
        F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north)).alias("geometry"), tags.alias("tags"),
    )


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(CITY, "Toronto", BBOX)], "code string, name string, bbox array<double>")
