"""The demand pipeline of all cities at once, from elements to points and pops."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assign, buildings, coverage, demand, grid_index, sites
from ..operators.numbering import numbered
from ..params import DEFAULTS, Params
from ..scratch import stored


@dataclass
class Demand:
    sites: DataFrame
    capacity: DataFrame
    pops: DataFrame
    points: DataFrame
    named: DataFrame


def demand_of(elements: DataFrame, places: DataFrame, params: Params = DEFAULTS) -> Demand:
    """Sites, their capacities and the flows between them.

    Sites that lie outside their city's box and get no building are left out,
    as is all but the first of several at one place.
    """
    at = sites.distinct_places(sites.with_order(sites.select_sites(elements)))
    return demand_of_sites(at, sites.within(buildings.building_capacity(elements, params), places), places, params)


def demand_of_sites(at: DataFrame, capacity: DataFrame, places: DataFrame, params: Params = DEFAULTS) -> Demand:
    near = assign.nearest_site(capacity, at)
    filled = stored(demand.site_capacity(at, near), "capacity")
    inside = sites.within(filled, places).select("city", "place_id")
    some = filled.filter("residents > 0 or jobs > 0").select("city", "place_id")
    filled = filled.join(inside.union(some).distinct(), ["city", "place_id"], "left_semi")
    shares = demand.site_shares(filled)
    pops = stored(demand.numbered_pops(demand.split_flows(demand.flows(shares, params), params)), "pops")
    return Demand(at, filled, pops, demand.demand_points(filled, pops), demand.named_pops(pops, filled))


def building_index(elements: DataFrame, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The indexed buildings, their cells and the index's numbers."""
    indexed = grid_index.indexed_buildings(elements, params)
    return indexed, grid_index.grid_cells(indexed, params), grid_index.index_stats(indexed)


def water_index(features: DataFrame, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Dimensions and covered cells of water features; no rows where a city has none."""
    dims = coverage.coverage_dims(coverage.union_box(coverage.feature_boxes(features)), params.water_cell)
    return dims, coverage.coverage_cells(polygon_boxes(features), dims)


def polygon_boxes(features: DataFrame) -> DataFrame:
    """Polygons of water features with their boxes, numbered in order within a city.

    The numbers are made from features and parts alone; rings stay where they are until then.
    """
    rings = coverage.polygons(features)
    nth = numbered(rings.select("city", "feature", "part"), ["city"], [F.col("feature"), F.col("part")], "polygon")
    lon, lat = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[0]))), F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[1])))
    edges = [F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north")]
    return rings.join(nth, ["city", "feature", "part"]).select("city", F.col("polygon").cast("int").alias("polygon"), *edges, "rings")


def chained(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps one after the other, in the order given."""
    for step in steps:
        df = df.transform(step)
    return df
