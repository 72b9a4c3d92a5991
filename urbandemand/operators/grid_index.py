"""Grid index of building footprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import box_of, cell, centroid, closed, stretched
from ..functions.num import number
from ..params import DEFAULTS, Params

#: Ordinals whose rows are numbered in one task.
ORDINAL_BLOCK = 1 << 16


def city_box(elements: DataFrame) -> DataFrame:
    """West, south, east and north of all points of a city, short geometries included."""
    own = elements.select("city", box_of(F.col("geometry")).alias("b"))
    return own.groupBy("city").agg(F.min("b.west").alias("west"), F.min("b.south").alias("south"), F.max("b.east").alias("east"), F.max("b.north").alias("north"))


def grid_dims(box: DataFrame, size: float = DEFAULTS.building_cell) -> DataFrame:
    """Cell width and numbers of columns and rows, of cells and (for buildings) of bounds."""
    out = box.withColumn("cell_x", stretched(size, (F.col("south") + F.col("north")) / 2)).withColumn("cell_y", F.lit(size))
    out = out.withColumn("columns", F.ceil((F.col("east") - F.col("west")) / F.col("cell_x")).cast("int")).withColumn("rows", F.ceil((F.col("north") - F.col("south")) / size).cast("int"))
    return out.withColumn("column_bounds", F.col("columns") + 1).withColumn("row_bounds", F.col("rows") + 1)


def indexed_buildings(elements: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``city, building, ordinal, west, south, east, north, depth, polygon, x, y``.

    All geometries of three points or more, whatever their use. ``building``
    counts them densely; with ``compat_ordinals`` it is the raw ordinal.
    ``x`` and ``y`` are the cell of the centre of mass, null outside the grid.
    """
    depth_tag = F.nullif(F.col("tags")["building:levels:underground"], F.lit(""))
    depth = F.when(depth_tag.isNotNull(), number(depth_tag)).otherwise(F.lit(1.0))
    # The ring is a column before functions go over it corner by corner.
    rows = elements.filter(F.size("geometry") >= 3).select("city", "ordinal", box_of(F.col("geometry")).alias("b"), depth.alias("depth"), closed(F.col("geometry")).alias("polygon"))
    rows = rows.withColumn("c", centroid(F.col("polygon")))
    dims = grid_dims(city_box(elements), params.building_cell).select("city", F.col("west").alias("w"), F.col("south").alias("s"), "cell_x", "cell_y", "columns", "rows")
    rows = rows.join(dims, "city")
    rows = rows.withColumn("building", F.col("ordinal")) if params.compat_ordinals else counted(rows)
    return rows.select(
        "city", "building", "ordinal", "b.west", "b.south", "b.east", "b.north", "depth", "polygon",
        cell(F.col("c.lon"), F.col("w"), F.col("cell_x"), F.col("columns")).alias("x"), cell(F.col("c.lat"), F.col("s"), F.col("cell_y"), F.col("rows")).alias("y"),
    )


def counted(rows: DataFrame, block: int = ORDINAL_BLOCK) -> DataFrame:
    """Adds ``building``, a row's dense number in its city in the order of ``ordinal``.

    Ordinals are taken in blocks: rows of a block are counted in one task, and
    the blocks' counts, a few numbers, are summed up in order.
    """
    rows = rows.withColumn("block", F.floor(F.col("ordinal") / block))
    per_block = rows.groupBy("city", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("city").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    start = per_block.select("city", "block", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("city", "block").orderBy("ordinal")) - 1
    return rows.withColumn("within", within).join(start, ["city", "block"]).withColumn("building", F.col("start") + F.col("within")).drop("block", "start", "within")


def grid_cells(indexed: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """``city, x, y, buildings``: ids of each cell's buildings in order."""
    rows = indexed if params.compat_ordinals else indexed.filter("x is not null and y is not null")
    return rows.groupBy("city", "x", "y").agg(F.sort_array(F.collect_list("building")).alias("buildings"))


def index_stats(indexed: DataFrame) -> DataFrame:
    """Number of buildings and the largest depth, which is at least 1."""
    deepest = F.greatest(F.lit(1.0), F.coalesce(F.max(F.when(~F.isnan("depth"), F.col("depth"))), F.lit(1.0)))
    return indexed.groupBy("city").agg(F.count("*").alias("count"), deepest.alias("max_depth"))
