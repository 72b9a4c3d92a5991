"""Assigning buildings to their nearest site.

A building lies in the Voronoi cell of its nearest site, so no cell is built.
Sites are put on a grid; a building looks at the sites of the nine cells around
it, and its nearest of them is the nearest of all if it is no further than the
edge of these cells. The rest look again on a grid four times as wide, until
the nine cells hold every site. Each city has cells of its own size. Each look is an equi-join on the cell, so
neither side is broadcast whole or met by every row of the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored

#: Sites in a cell of the first grid, on average.
PER_CELL = 2.0


def nearest_site(buildings: DataFrame, sites: DataFrame, per_cell: float = PER_CELL) -> DataFrame:
    """Each building's columns with ``place_id`` and ``d2`` of its nearest site.

    Distance is planar, in degrees; of sites equally near the one with the
    smallest ``site_ord`` is taken. A city without sites assigns none. A
    building is told apart by ``city`` and ``building_id``.
    """
    sites = stored(sites.select("city", "lon", "lat", "site_ord", "place_id"), "sites")  # read once a look
    around = sites.groupBy("city").agg(F.count("*").alias("n"), F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n_edge"))
    extent = F.greatest(F.col("e") - F.col("w"), F.col("n_edge") - F.col("s"), F.lit(1e-6))
    around = stored(around.withColumn("extent", extent).withColumn("size0", extent / F.greatest(F.lit(1.0), F.sqrt(F.col("n") / per_cell))), "cities")
    if not around.limit(1).count():
        return buildings.limit(0).withColumn("place_id", F.lit(None).cast("long")).withColumn("d2", F.lit(None).cast("double"))
    # A building outside the sites' box is moved to its edge to choose cells.
    rest = buildings.join(around.drop("n"), "city")
    x, y = F.least(F.greatest("lon", "w"), "e"), F.least(F.greatest("lat", "s"), "n_edge")
    own = [F.col(c) for c in buildings.columns]
    frame = ["w", "s", "e", "n_edge", "extent", "size0"]
    wider = 1
    found: DataFrame | None = None
    while True:
        size = F.col("size0") * wider
        cells = sites.join(around.select("city", "w", "s", "size0"), "city").select("city", F.floor((F.col("lon") - F.col("w")) / size).alias("cx"), F.floor((F.col("lat") - F.col("s")) / size).alias("cy"), F.col("lon").alias("slon"), F.col("lat").alias("slat"), "site_ord", "place_id")
        near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        looks = rest.select(*own, *frame, F.floor((x - F.col("w")) / size).alias("ox"), F.floor((y - F.col("s")) / size).alias("oy"), F.explode(near).alias("o")).select(*own, *frame, "ox", "oy", (F.col("ox") + F.col("o.dx")).alias("cx"), (F.col("oy") + F.col("o.dy")).alias("cy"))
        met = looks.join(cells, ["city", "cx", "cy"], "left")
        dx, dy = F.col("lon") - F.col("slon"), F.col("lat") - F.col("slat")
        best = met.groupBy(*own, *frame, "ox", "oy").agg(F.min(F.when(F.col("place_id").isNotNull(), F.struct((dx * dx + dy * dy).alias("d2"), "site_ord", "place_id"))).alias("m"))
        # How far the nine cells reach from the building on every side.
        west, south = F.col("w") + (F.col("ox") - 1) * size, F.col("s") + (F.col("oy") - 1) * size
        reach = F.least(F.col("lon") - west, west + 3 * size - F.col("lon"), F.col("lat") - south, south + 3 * size - F.col("lat"))
        safe = (size >= F.col("extent")) | ((reach > 0) & (F.col("m.d2") < reach * reach * (1 - 1e-9)))
        best = stored(best.withColumn("safe", F.coalesce(safe, F.lit(False))), "nearest")
        done = best.filter("safe").select(*own, F.col("m.place_id").alias("place_id"), F.col("m.d2").alias("d2"))
        found = done if found is None else found.unionByName(done)
        rest = best.filter("not safe").select(*own, *frame)
        if not rest.limit(1).count():
            return found
        wider *= 4


def nearest_site_brute(buildings: DataFrame, sites: DataFrame) -> DataFrame:
    """The same by comparing every pair: a yardstick for tests and small cities."""
    pairs = buildings.join(sites.select("city", F.col("lon").alias("slon"), F.col("lat").alias("slat"), "site_ord", "place_id"), "city")
    dx, dy = F.col("lon") - F.col("slon"), F.col("lat") - F.col("slat")
    best = pairs.groupBy(*buildings.columns).agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "site_ord", "place_id")).alias("m"))
    return best.select(*buildings.columns, F.col("m.place_id").alias("place_id"), F.col("m.d2").alias("d2"))
