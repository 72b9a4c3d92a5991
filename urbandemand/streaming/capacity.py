"""Running residents and jobs of sites from a stream of capacities.

An addition: the batch model has no unbounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_capacity(assigned: DataFrame) -> DataFrame:
    """Sums by city and site of a stream of assigned buildings; write it in complete or update mode."""
    return assigned.groupBy("city", "place_id").agg(F.sum(F.coalesce("residents", F.lit(0))).alias("residents"), F.sum(F.coalesce("jobs", F.lit(0))).alias("jobs"))
