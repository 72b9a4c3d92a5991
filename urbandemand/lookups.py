"""Lookup values of the demand model, as small DataFrames or literal maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Square feet of floor for one resident, by building type.
SQFT_PER_RESIDENT = {
    "yes": 600, "apartments": 240, "barracks": 100, "bungalow": 600, "cabin": 600, "detached": 600, "annexe": 240,
    "dormitory": 125, "farm": 600, "ger": 240, "hotel": 240, "house": 600, "houseboat": 600, "residential": 600,
    "semidetached_house": 400, "static_caravan": 500, "stilt_house": 600, "terrace": 500, "tree_house": 240, "trullo": 240,
}

# Square feet of floor for one job, by building type.
SQFT_PER_JOB = {
    "commercial": 150, "industrial": 500, "kiosk": 50, "office": 150, "retail": 300, "supermarket": 300, "warehouse": 500,
    "religious": 100, "cathedral": 100, "chapel": 100, "church": 100, "kingdom_hall": 100, "monastery": 100, "mosque": 100,
    "presbytery": 100, "shrine": 100, "synagogue": 100, "temple": 100, "bakehouse": 300, "college": 250, "fire_station": 500,
    "government": 150, "gatehouse": 150, "hospital": 150, "kindergarten": 100, "museum": 300, "public": 300, "school": 100,
    "train_station": 1000, "transportation": 1000, "university": 250, "grandstand": 150, "pavilion": 150, "riding_hall": 150,
    "sports_hall": 150, "sports_centre": 150, "stadium": 150,
}

# Road class of each highway tag that is read.
ROAD_CLASS = {
    "motorway": "highway", "motorway_link": "highway", "trunk": "major", "trunk_link": "major", "primary": "major",
    "primary_link": "major", "secondary": "minor", "secondary_link": "minor", "tertiary": "minor", "tertiary_link": "minor",
    "unclassified": "minor", "residential": "minor",
}

# Aeroways read as runways, and kinds of water that count.
AEROWAYS = ("runway", "taxiway", "apron")
WATER_KINDS = ("ocean", "basin", "river", "canal", "lake", "dock", "water")

# Codes of the cities that need no data of ours.
KNOWN_CITIES = (
    "ATL", "AUS", "BAL", "BOS", "CHI", "CIN", "CLE", "CLT", "DAL", "DC", "DEN", "DET", "HNL",
    "HOU", "IND", "MIA", "MSP", "NYC", "PDX", "PHL", "PIT", "SAN", "SEA", "SF", "SLC", "STL",
)


def looked_up(values: dict[str, object], key: Column) -> Column:
    """The value of ``key`` in a literal map, null where it has none."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]
