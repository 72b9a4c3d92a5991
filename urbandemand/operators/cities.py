"""City lists: defaults, unions and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookups import KNOWN_CITIES


def view_state(given: Column, bbox: Column) -> Column:
    """The given view, or one on the middle of the box."""
    return F.coalesce(given, F.struct(F.lit(13.5).alias("zoom"), ((bbox[1] + bbox[3]) / 2).alias("latitude"), ((bbox[0] + bbox[2]) / 2).alias("longitude"), F.lit(0.0).alias("bearing")))


def entered_view(zoom: Column, latitude: Column, longitude: Column, bearing: Column) -> Column:
    """A view from form fields: zoom 12 and bearing 0 where they are no numbers; null without a place."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c)
    made = F.struct(F.when(ok(zoom), zoom).otherwise(F.lit(12.0)).alias("zoom"), latitude.alias("latitude"), longitude.alias("longitude"), F.when(ok(bearing), bearing).otherwise(F.lit(0.0)).alias("bearing"))
    return F.when(ok(latitude) & ok(longitude), made)


def city_entries(places: DataFrame) -> DataFrame:
    return places.select("name", "code", "description", "population", view_state(F.col("initialViewState"), F.col("bbox")).alias("initialViewState"))


def valid_places(places: DataFrame) -> DataFrame:
    """Places with a code, a box of four numbers, and no thumbnail box of another length."""
    return places.filter((F.trim("code") != "") & (F.size("bbox") == 4) & ~F.exists("bbox", lambda x: x.isNull() | F.isnan(x)) & (F.col("thumbnailBbox").isNull() | (F.size("thumbnailBbox") == 4)))


def with_data(places: DataFrame, index: DataFrame) -> DataFrame:
    """Places that have an index."""
    return places.join(index.select(F.col("city").alias("code")), "code", "left_semi")


def without_data(places: DataFrame, index: DataFrame) -> DataFrame:
    """Places that have none, and are none of the known cities."""
    return places.join(index.select(F.col("city").alias("code")), "code", "left_anti").filter(~F.col("code").isin(*KNOWN_CITIES))


def missing_outputs(places: DataFrame, outputs: DataFrame, wanted: list[str]) -> DataFrame:
    """``code, output`` of what ``outputs`` (city, output) lacks."""
    need = places.select("code", F.explode(F.array(*[F.lit(x) for x in wanted])).alias("output"))
    return need.join(outputs.select(F.col("city").alias("code"), "output"), ["code", "output"], "left_anti")
