"""Sites: the neighbourhoods, terminals and universities that demand is gathered at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import numbered

#: Integers below this are ordered as numbers when they are keys.
_INDEX_LIMIT = 4294967295


def kind_of(tags: Column) -> Column:
    """Which kind of site an element is, null if none."""
    return (
        F.when(tags["aeroway"] == "terminal", F.lit("terminal"))
        .when(tags["amenity"] == "university", F.lit("university"))
        .when(tags["place"].isin("quarter", "neighbourhood"), tags["place"])
    )


def select_sites(elements: DataFrame) -> DataFrame:
    """``city, place_id, kind, name, lon, lat, ordinal`` of the elements that are sites.

    Nodes are where they say, ways and relations at the middle of their
    bounds; other types and elements without a place are left out. Of elements
    that share an id the last counts. ``ordinal`` is the element's place in
    its file, which must come with it.
    """
    node = F.col("type") == "node"
    area = F.col("type").isin("way", "relation")
    lon = F.when(node, F.col("lon")).when(area, (F.col("bounds.minlon") + F.col("bounds.maxlon")) / 2)
    lat = F.when(node, F.col("lat")).when(area, (F.col("bounds.minlat") + F.col("bounds.maxlat")) / 2)
    found = elements.select("city", F.col("id").alias("place_id"), kind_of(F.col("tags")).alias("kind"), F.col("tags")["name"].alias("name"), lon.alias("lon"), lat.alias("lat"), "ordinal")
    found = found.filter("kind is not null and lon is not null and lat is not null")
    return last_of_each(found, ["city", "place_id"])


def last_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the one with the largest ordinal, at the first one's place."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ordinal").alias("r"), F.min("ordinal").alias("first_ordinal"))
    return one.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "ordinal"], F.col("first_ordinal").alias("ordinal"))


def key_order(key: Column, ordinal: Column) -> list[Column]:
    """Sort keys of keyed objects: small integers as numbers first, others as they came."""
    small = (key >= 0) & (key < _INDEX_LIMIT)
    return [F.when(small, 0).otherwise(1), F.when(small, key), F.when(~small, ordinal)]


def with_order(sites: DataFrame) -> DataFrame:
    """``site_ord``: each site's place in its city, counted from 0; no task numbers a whole city."""
    return numbered(sites, ["city"], [*key_order(F.col("place_id"), F.col("ordinal")), F.col("place_id")], "site_ord").withColumn("site_ord", F.col("site_ord").cast("int"))


def distinct_places(sites: DataFrame) -> DataFrame:
    """Of sites at one place, the first of its city."""
    first = F.row_number().over(Window.partitionBy("city", "lon", "lat").orderBy("site_ord"))
    return sites.withColumn("nth", first).filter("nth = 1").drop("nth")


def within(df: DataFrame, places: DataFrame) -> DataFrame:
    """Rows whose lon and lat lie in their city's box, edges included."""
    box = places.select(F.col("code").alias("city"), F.col("bbox").alias("box"))
    inside = (F.col("lon") >= F.col("box")[0]) & (F.col("lon") <= F.col("box")[2]) & (F.col("lat") >= F.col("box")[1]) & (F.col("lat") <= F.col("box")[3])
    return df.join(box, "city").filter(inside).drop("box")


def public_ids(sites: DataFrame) -> DataFrame:
    """``public_id``: terminals and universities numbered over all cities, others by their id."""
    is_special = F.coalesce(F.col("kind").isin("terminal", "university"), F.lit(False))
    special = numbered(sites.filter(is_special), ["kind"], [F.col("city"), F.col("site_ord")], "_number")
    named = special.withColumn("public_id", F.concat(F.when(F.col("kind") == "terminal", "AIR_Terminal_").otherwise("UNI_"), F.col("_number").cast("string"))).drop("_number")
    return named.unionByName(sites.filter(~is_special).withColumn("public_id", F.col("place_id").cast("string")))
