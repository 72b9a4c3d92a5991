"""A drawing of a city's water, from tiles to SVG."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buffer import buffer_degrees
from ..functions.shapes import svg

#: Degrees around a line; from ``FINE_ZOOM`` on a line is drawn thinner.
WIDE, THIN, FINE_ZOOM = 0.0005, 0.00025, 10


def drawn_shapes(features: DataFrame) -> DataFrame:
    """``city, kind, coordinates``: lines as the polygons around them, other shapes as they are.

    ``features`` has city, kind, coordinates (JSON) and properties. Lines of a
    MultiLineString whose surroundings meet are one polygon; points are not drawn.
    """
    zoom = F.col("properties")["min_zoom"].cast("double")
    radius = F.when(zoom >= FINE_ZOOM, F.lit(THIN)).otherwise(F.lit(WIDE))
    lines = features.filter(F.col("kind").isin("LineString", "MultiLineString"))
    many = F.when(F.col("kind") == "LineString", F.array(F.from_json("coordinates", "array<array<double>>"))).otherwise(F.from_json("coordinates", "array<array<array<double>>>"))
    one = lines.select("city", F.explode(buffer_degrees(many, radius)).alias("polygon"))
    around = one.select("city", F.lit("Polygon").alias("kind"), F.to_json("polygon").alias("coordinates"))
    return features.filter(F.col("kind").isin("Polygon", "MultiPolygon")).select("city", "kind", "coordinates").unionByName(around)


def thumbnails(features: DataFrame, size: int = 800) -> DataFrame:
    """``city, svg``: one drawing a city; it holds the tiles of the city's thumbnail box, which bounds a group."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"city": b["city"], "svg": [svg([p for kind, text in zip(kinds, texts) for p in ([json.loads(text)] if kind == "Polygon" else json.loads(text))], size) for kinds, texts in zip(b["kinds"], b["texts"])]})

    shapes = drawn_shapes(features).groupBy("city").agg(F.sort_array(F.collect_list(F.struct("kind", "coordinates"))).alias("shapes"))
    return shapes.select("city", F.col("shapes.kind").alias("kinds"), F.col("shapes.coordinates").alias("texts")).mapInPandas(draw, "city string, svg string")
