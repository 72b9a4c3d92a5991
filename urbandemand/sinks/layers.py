"""A city's layers as files, in the order of its elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.roads import road_features, runway_features
from ..params import DEFAULTS, Params
from .ordered import write_features, write_ordered


def write_roads(elements: DataFrame, path: str, params: Params = DEFAULTS, compression: str = "none") -> None:
    """Roads as line features of each city."""
    rows = road_features(elements, params, ("ordinal",))
    properties = F.struct(F.col("road_class").alias("roadClass"), "structure", "name")
    write_features(rows.select("city", "ordinal", F.lit("LineString").alias("kind"), F.to_json("coordinates").alias("coordinates"), properties.alias("properties")), path, ["ordinal"], compression)


def write_runways(elements: DataFrame, path: str, compression: str = "none") -> None:
    """Runways, taxiways and aprons as polygon features of each city."""
    rows = runway_features(elements, ("ordinal",))
    properties = F.struct(F.col("road_type").alias("roadType"), "z_order", "aeroway", "osm_way_id", "area")
    write_features(rows.select("city", "ordinal", "kind", "coordinates", properties.alias("properties")), path, ["ordinal"], compression)


def write_elements(elements: DataFrame, path: str, compression: str = "none") -> None:
    """Elements (of a scan: places, buildings) as an array of objects for each city, as they were read."""
    told = [c for c in elements.columns if c not in ("city", "ordinal") and not c.startswith("tag_")]
    write_ordered(elements, path, "city", ["ordinal"], F.to_json(F.struct(*told)), compression=compression)
