"""Buildings: residents and jobs from floor area and use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import closed, ring_area
from ..functions.num import at_least_one
from ..lookups import SQFT_PER_JOB, SQFT_PER_RESIDENT, looked_up
from ..params import DEFAULTS, Params
from .sites import last_of_each


def use_of(kind: Column) -> Column:
    """``resident``, ``job`` or null for a building type."""
    return F.when(kind.isin(*SQFT_PER_RESIDENT), "resident").when(kind.isin(*SQFT_PER_JOB), "job")


def capacities(area_m2: Column, kind: Column, levels: Column, aeroway: Column, params: Params = DEFAULTS) -> tuple[Column, Column]:
    """Residents and jobs of a building; null where it is not of that use."""
    floor = area_m2 * at_least_one(levels) * F.lit(params.sqft_per_m2)
    residents = F.floor(floor / looked_up(SQFT_PER_RESIDENT, kind))
    jobs = F.floor(floor / looked_up(SQFT_PER_JOB, kind))
    jobs = F.when(aeroway == "terminal", jobs * params.terminal_factor).otherwise(jobs)
    return residents, jobs


def building_capacity(elements: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``city, building_id, use, residents, jobs, lon, lat`` of classified buildings.

    Elements without a building tag, of a type in neither table, or with
    fewer than three points are left out; the place is the middle of the
    bounds; of elements that share an id the last counts.
    """
    tags = F.col("tags")
    kind = F.nullif(tags["building"], F.lit(""))
    rows = elements.filter(kind.isNotNull() & (F.size("geometry") >= 3)).filter(use_of(kind).isNotNull())
    rows = rows.withColumn("ring", closed(F.col("geometry"))).withColumn("area", ring_area(F.col("ring")))
    residents, jobs = capacities(F.col("area"), kind, tags["building:levels"], tags["aeroway"], params)
    out = rows.select(
        "city", F.col("id").alias("building_id"), use_of(kind).alias("use"), residents.alias("residents"), jobs.alias("jobs"),
        ((F.col("bounds.minlon") + F.col("bounds.maxlon")) / 2).alias("lon"), ((F.col("bounds.minlat") + F.col("bounds.maxlat")) / 2).alias("lat"), "ordinal",
    )
    return last_of_each(out, ["city", "building_id"]).drop("ordinal")
