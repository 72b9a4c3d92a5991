"""Coverage index of water polygons: every cell that a polygon's box touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import stretched
from ..params import DEFAULTS, Params

RING = "array<array<double>>"


def polygons(features: DataFrame) -> DataFrame:
    """``city, feature, part, rings`` of Polygon and MultiPolygon features.

    ``features`` has city, feature (its ordinal), kind (the geometry's type)
    and coordinates (JSON text).
    """
    one = F.array(F.from_json("coordinates", f"array<{RING}>"))
    many = F.from_json("coordinates", f"array<array<{RING}>>")
    parts = F.when(F.col("kind") == "Polygon", one).when(F.col("kind") == "MultiPolygon", many)
    return features.select("city", "feature", F.posexplode(parts).alias("part", "rings"))


def feature_boxes(features: DataFrame) -> DataFrame:
    """West, south, east and north of every feature of whatever type."""
    # All numbers of the nested text in order are lon, lat, lon, lat, ...
    flat = F.transform(F.regexp_extract_all("coordinates", F.lit(r"-?[0-9.]+(?:[eE][+-]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    at = features.select("city", "feature", flat.alias("flat")).filter(F.size("flat") >= 2)
    lon, lat = F.filter("flat", lambda _, i: i % 2 == 0), F.filter("flat", lambda _, i: i % 2 == 1)
    return at.select("city", "feature", F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def union_box(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("city").agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def coverage_dims(box: DataFrame, size: float = DEFAULTS.water_cell) -> DataFrame:
    out = box.withColumn("cell_x", F.lit(size) / F.cos((F.col("south") + F.col("north")) / 2 * 3.141592653589793 / 180)).withColumn("cell_y", F.lit(size))
    return out.withColumn("columns", F.ceil((F.col("east") - F.col("west")) / F.col("cell_x")).cast("int")).withColumn("rows", F.ceil((F.col("north") - F.col("south")) / size).cast("int"))


def cell_ranges(boxes: DataFrame, dims: DataFrame) -> DataFrame:
    """``city, polygon, c0, c1, r0, r1``: first and last column and row of each box, cut to the grid."""
    d = dims.select("city", F.col("west").alias("w"), F.col("south").alias("s"), "cell_x", "cell_y", "columns", "rows")
    at = lambda c, low, size: F.floor((F.col(c) - F.col(low)) / F.col(size)).cast("int")
    return boxes.join(d, "city").select(
        "city", "polygon",
        F.greatest(F.lit(0), at("west", "w", "cell_x")).alias("c0"), F.least(F.col("columns") - 1, at("east", "w", "cell_x")).alias("c1"),
        F.greatest(F.lit(0), at("south", "s", "cell_y")).alias("r0"), F.least(F.col("rows") - 1, at("north", "s", "cell_y")).alias("r1"),
    ).filter("c1 >= c0 and r1 >= r0")


def coverage_cells(boxes: DataFrame, dims: DataFrame) -> DataFrame:
    """``city, x, y, polygon``: the cells from each box's first to last column and row.

    ``boxes`` has city, polygon, west, south, east and north. Ranges are cut to
    the grid; a grid without columns or rows has no cells.
    """
    r = cell_ranges(boxes, dims)
    return r.select("city", "polygon", F.explode(F.sequence("c0", "c1")).alias("x"), "r0", "r1").select("city", "polygon", "x", F.explode(F.sequence("r0", "r1")).alias("y"))


def cover(boxes: DataFrame, dims: DataFrame) -> DataFrame:
    """``city, polygon, level, x, y``: each box as few squares of cells, of sides 1, 2, 4, ...

    A square of a level lies at multiples of its side; one is in the cover if
    it lies in the box and the next larger square around it doesn't. Of each
    level that is a frame one square wide, so an ocean's box has as many
    squares as four times the sum of its sides in cells at most, and not as many as its area has cells.
    Boxes are dealt over as many tasks as a shuffle has before they are cut up, as a file of many may be one
    task's; what is grouped by polygon needs no further shuffle.
    """
    tasks = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cell_ranges(boxes, dims).repartition(tasks, "polygon")
    most = F.floor(F.log2(F.least(F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")) + 1)).cast("int")
    at = r.withColumn("level", F.explode(F.sequence(F.lit(0), most)))

    def bounds(side: Column, first: str, last: str) -> tuple[Column, Column]:
        return F.ceil(F.col(first) / side).cast("int"), (F.floor((F.col(last) + 1) / side) - 1).cast("int")

    side = F.pow(F.lit(2), F.col("level"))
    for name, first, last in (("x", "c0", "c1"), ("y", "r0", "r1")):
        low, high = bounds(side, first, last)
        inner_low, inner_high = bounds(side * 2, first, last)
        at = at.withColumns({f"{name}0": low, f"{name}1": high, f"{name}i0": inner_low * 2, f"{name}i1": inner_high * 2 + 1})
    at = at.filter("x1 >= x0 and y1 >= y0").withColumn("framed", F.expr("xi1 > xi0 and yi1 > yi0"))
    at = at.withColumn("x", F.explode(F.sequence("x0", "x1")))
    none = F.array().cast("array<int>")
    edge = F.concat(F.when(F.col("y0") < F.col("yi0"), F.sequence(F.col("y0"), F.col("yi0") - 1)).otherwise(none), F.when(F.col("y1") > F.col("yi1"), F.sequence(F.col("yi1") + 1, F.col("y1"))).otherwise(none))
    rows = F.when(F.col("framed") & F.col("x").between(F.col("xi0"), F.col("xi1")), edge).otherwise(F.sequence("y0", "y1"))
    return at.select("city", "polygon", "level", "x", F.explode(rows).alias("y"))


def cover_cells(squares: DataFrame) -> DataFrame:
    """A cover as single cells: the rows of ``coverage_cells``."""
    side = F.pow(F.lit(2), F.col("level")).cast("int")
    x = squares.select("city", "polygon", "y", side.alias("side"), F.explode(F.sequence(F.col("x") * side, (F.col("x") + 1) * side - 1)).alias("x"))
    return x.select("city", "polygon", "x", F.explode(F.sequence(F.col("y") * F.col("side"), (F.col("y") + 1) * F.col("side") - 1)).alias("y"))


def _ancestors(squares: DataFrame, levels: int) -> DataFrame:
    """Squares with all larger ones around them: ``up`` is how many levels above."""
    up = F.explode(F.sequence(F.lit(0), F.lit(levels) - F.col("level"))).alias("up")
    at = squares.select("*", up)
    side = F.pow(F.lit(2), F.col("up"))
    return at.withColumns({"level": F.col("level") + F.col("up"), "x": F.floor(F.col("x") / side).cast("int"), "y": F.floor(F.col("y") / side).cast("int")})


LEVELS = 24


def covering(cells: DataFrame, squares: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``cells`` (city, x, y and others) with each ``polygon`` whose cover holds the cell; every level is met by an equal key."""
    up = _ancestors(cells.withColumn("level", F.lit(0)), levels).withColumnsRenamed({"x": "_x", "y": "_y"})
    found = up.join(squares.withColumnsRenamed({"x": "_x", "y": "_y"}), ["city", "level", "_x", "_y"])
    kept = [c for c in cells.columns if c not in ("city", "x", "y")]
    return found.select("city", *kept, "polygon")


def meeting(wanted: DataFrame, squares: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``city, query, polygon`` of covers that meet: one of two squares lies in the other.

    ``wanted`` is a cover whose column is ``query`` instead of polygon.
    """
    key = ["city", "level", "x", "y"]
    in_polygon = _ancestors(wanted, levels).join(squares, key)
    in_query = _ancestors(squares, levels).filter("up > 0").join(wanted, key)
    return in_polygon.select("city", "query", "polygon").unionByName(in_query.select("city", "query", "polygon")).distinct()


def coverage_stats(boxes: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return boxes.groupBy("city").agg(F.count("*").alias("count")).withColumn("min_depth", F.lit(params.water_depth)).withColumn("max_depth", F.lit(params.water_depth))
