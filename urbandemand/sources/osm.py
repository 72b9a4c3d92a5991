"""Readers of element files, GeoJSON, place configurations and staged tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curve import hilbert
from ..lookups import AEROWAYS, ROAD_CLASS
from ..schemas import CONFIG, FEATURES, OSM_ELEMENT
from .json_array import read_array


def read_elements(spark: SparkSession, path: str, city: str) -> DataFrame:
    """Elements of a JSON array file with their ``ordinal``, their place in it.

    Any number of tasks read a file; see ``json_array``.
    """
    return read_array(spark, path, OSM_ELEMENT).drop("document").select(F.lit(city).alias("city"), "*")


#: Cells of the curve that staged elements lie along, as bits of a side, and elements of a row group.
CURVE_BITS = 16
GROUP_ROWS = 20_000
_EDGES = ("west", "south", "east", "north")


def edges(elements: DataFrame) -> DataFrame:
    """Elements with the edges of their bounds as columns; those of a node are its place."""
    node = F.col("type") == "node"
    of = {"west": ("lon", "bounds.minlon"), "south": ("lat", "bounds.minlat"), "east": ("lon", "bounds.maxlon"), "north": ("lat", "bounds.maxlat")}
    return elements.withColumns({name: F.when(node, F.col(point)).otherwise(F.col(bound)) for name, (point, bound) in of.items()})


def stage_elements(elements: DataFrame, path: str, group_rows: int = GROUP_ROWS) -> None:
    """Write elements as Parquet by city, along a space-filling curve, with tags that are filtered on and bounds as columns of their own.

    Elements near each other share row groups, whose minima and maxima of the
    bounds let a box skip all others. A city's elements are dealt to as many
    tasks as their ranges of the curve need.
    """
    hot = {k: F.col("tags")[k].alias(f"tag_{k}") for k in ("building", "place", "aeroway", "amenity", "highway")}
    cell = lambda low, high, start, width: F.least(F.lit((1 << CURVE_BITS) - 1), F.greatest(F.lit(0), F.floor(((F.col(low) + F.col(high)) / 2 - start) / width * (1 << CURVE_BITS))))
    along = hilbert(cell("west", "east", -180, 360), cell("south", "north", -90, 180), CURVE_BITS)
    rows = edges(elements).select("*", *hot.values()).withColumn("_along", along)
    dealt = rows.repartitionByRange("city", "_along", "id").sortWithinPartitions("city", "_along", "id").drop("_along")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.row.count.limit", group_rows).partitionBy("city").parquet(path)


def read_staged(spark: SparkSession, path: str, city: str | None = None, box: list[float] | None = None) -> DataFrame:
    """Staged elements of a city that meet a west-south-east-north box; what lies elsewhere isn't read."""
    rows = spark.read.parquet(path)
    if city is not None:
        rows = rows.filter(F.col("city") == city)
    if box is not None:
        west, south, east, north = (F.lit(float(x)) for x in box)
        rows = rows.filter((F.col("east") >= west) & (F.col("west") <= east) & (F.col("north") >= south) & (F.col("south") <= north))
    return rows.drop(*_EDGES)


def in_box(bbox: Column) -> Column:
    """Whether an element meets a west-south-east-north box."""
    node = F.col("type") == "node"
    inside = F.col("lon").between(bbox[0], bbox[2]) & F.col("lat").between(bbox[1], bbox[3])
    meets = (F.col("bounds.maxlon") >= bbox[0]) & (F.col("bounds.minlon") <= bbox[2]) & (F.col("bounds.maxlat") >= bbox[1]) & (F.col("bounds.minlat") <= bbox[3])
    return F.when(node, inside).otherwise(meets)


def scan(elements: DataFrame, what: str) -> DataFrame:
    """The elements that a layer is made of: buildings, places, roads or runways."""
    tag = lambda k: F.col("tags")[k]
    wanted = {
        "buildings": (F.col("type") == "way") & tag("building").isNotNull(),
        "places": tag("place").isin("neighbourhood", "quarter") | (tag("aeroway") == "terminal") | tag("amenity").isNotNull(),
        "roads": (F.col("type") == "way") & tag("highway").isin(*ROAD_CLASS),
        "runways": (F.col("type") == "way") & tag("aeroway").isin(*AEROWAYS),
    }
    return elements.filter(wanted[what])


def unioned(*scans: DataFrame) -> DataFrame:
    """Scans together, each element once."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["city", "type", "id"])


def read_features(spark: SparkSession, path: str, city: str) -> DataFrame:
    """``city, feature, kind, coordinates, properties`` of a GeoJSON file; no rows where it has none or is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], "city string, feature int, kind string, coordinates string, properties map<string,string>")
    rows = spark.read.schema(FEATURES).option("multiLine", True).json(path)
    at = rows.select(F.posexplode("features").alias("feature", "f"))
    return at.select(F.lit(city).alias("city"), "feature", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Places of a configuration file, one row each."""
    return spark.read.schema(CONFIG).option("multiLine", True).json(path).select(F.posexplode("places").alias("city_ord", "p")).select("city_ord", "p.*")


def place_of(places: DataFrame, code: str) -> DataFrame:
    """The place with a code, of several the first."""
    return places.filter(F.col("code") == code).orderBy("city_ord").limit(1)


def read_zipped(spark: SparkSession, path: str, endings: tuple[str, ...] = (".json", ".geojson")) -> DataFrame:
    """``pack, name, payload``: files of those endings in zip packs; a pack that can't be read has none."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pack, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in z.namelist():
                            if name.endswith(endings):
                                yield pd.DataFrame([(pack, name, z.read(name))], columns=["pack", "name", "payload"])
                except (zipfile.BadZipFile, EOFError):
                    continue

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpacked, "pack string, name string, payload binary")


def read_processed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that a sink has written."""
    return spark.read.schema(schema).json(path)
