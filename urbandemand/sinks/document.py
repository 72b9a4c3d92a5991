"""One document for each city, assembled at the very end.

The tall tables are the product; a document gathers one city's rows in one
task, which is bounded by what a reader of the document must hold anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _listed(rows: DataFrame, item, order, name: str) -> DataFrame:
    """``city`` and an array of ``item`` in ``order``."""
    got = rows.groupBy("city").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("i")))).alias("l"))
    return got.select("city", F.transform("l", lambda x: x["i"]).alias(name))


def demand_document(points: DataFrame, pops: DataFrame) -> DataFrame:
    """``city, document`` with all points and pops as JSON."""
    point = F.struct("id", "location", "jobs", "residents", F.col("pop_ids").alias("popIds"))
    path = [F.col("driving_path").alias("drivingPath")] if "driving_path" in pops.columns else []
    pop = F.struct(F.col("residence_id").alias("residenceId"), F.col("job_id").alias("jobId"), "size", F.col("driving_distance").alias("drivingDistance"), F.col("driving_seconds").alias("drivingSeconds"), "id", *path)
    both = _listed(points, point, F.col("site_ord"), "points").join(_listed(pops, pop, F.col("id").cast("long"), "pops"), "city", "left")
    none = F.from_json(F.lit("[]"), dict(both.dtypes)["pops"])
    return both.select("city", F.to_json(F.struct("points", F.coalesce("pops", none).alias("pops"))).alias("document"))


def cell_rows(cells: DataFrame) -> DataFrame:
    """Cells as ``[x, y, id, ...]`` with ``first``, by which they are listed."""
    ids = F.col("buildings").cast("array<int>")
    return cells.select("city", F.concat(F.array("x", "y"), ids).alias("cell"), F.array_min(ids).alias("first"))


def index_document(box: DataFrame, dims: DataFrame, cells: DataFrame, indexed: DataFrame, stats: DataFrame, cell_size: float) -> DataFrame:
    """``city, document`` of a building grid index as JSON."""
    one = _listed(cell_rows(cells), F.col("cell"), F.col("first"), "cells")
    ring = F.array(F.transform("polygon", lambda p: F.array(p["lon"], p["lat"])))
    rows = _listed(indexed, F.struct(F.array("west", "south", "east", "north").alias("b"), F.col("depth").alias("f"), ring.alias("p")), F.col("ordinal"), "buildings")
    head = box.select("city", F.array("west", "south", "east", "north").alias("bbox")).join(dims.select("city", F.array("column_bounds", "row_bounds").alias("grid")), "city")
    every = head.join(one, "city", "left").join(rows, "city", "left").join(stats.select("city", F.struct("count", F.col("max_depth").alias("maxDepth")).alias("stats")), "city", "left")
    return every.select("city", F.to_json(F.struct(F.lit(cell_size).alias("cs"), "bbox", "grid", "cells", "buildings", "stats")).alias("document"))


def water_document(box: DataFrame, dims: DataFrame, cells: DataFrame, polygons: DataFrame, stats: DataFrame, cell_size: float, depth: int) -> DataFrame:
    """``city, document`` of a water index as JSON; no row where a city has no water.

    ``polygons`` has city, polygon, west, south, east, north and rings.
    """
    grouped = cells.groupBy("city", "x", "y").agg(F.sort_array(F.collect_list("polygon")).alias("buildings"))
    one = _listed(cell_rows(grouped), F.col("cell"), F.struct("first", "cell"), "cells")
    rows = _listed(polygons, F.struct(F.array("west", "south", "east", "north").alias("b"), F.lit(depth).alias("d"), F.col("rings").alias("p")), F.col("polygon"), "depths")
    head = box.select("city", F.array("west", "south", "east", "north").alias("bbox")).join(dims.select("city", F.array("columns", "rows").alias("grid")), "city")
    every = head.join(one, "city", "left").join(rows, "city").join(stats.select("city", F.struct("count", F.col("min_depth").alias("minDepth"), F.col("max_depth").alias("maxDepth")).alias("stats")), "city")
    return every.select("city", F.to_json(F.struct(F.lit(cell_size).alias("cs"), "bbox", "grid", "cells", "depths", "stats")).alias("document"))


def feature_collection(features: DataFrame, properties: list[str]) -> DataFrame:
    """``city, document`` of features (city, kind, coordinates as JSON text, properties)."""
    coordinates = F.col("coordinates") if dict(features.dtypes)["coordinates"] == "string" else F.to_json("coordinates")
    body = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)) if properties else F.lit("{}"), F.lit(',"geometry":{"type":"'), F.col("kind"), F.lit('","coordinates":'), coordinates, F.lit("}}"))
    got = features.select("city", body.alias("f")).groupBy("city").agg(F.array_join(F.sort_array(F.collect_list("f")), ",").alias("f"))
    return got.select("city", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}")).alias("document"))


def write_documents(documents: DataFrame, path: str, compression: str = "none") -> None:
    """Each city's document in a folder of its own; other cities' stay."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("city").text(path)
