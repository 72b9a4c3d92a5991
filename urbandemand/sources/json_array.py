"""One JSON array of objects, however large, read by many tasks.

The text source cuts a file at closing braces, so its splits start behind a
brace wherever the file system cuts the bytes. A piece up to a brace may begin
inside a string or outside of one; what it does to the nesting is kept for
both. A split's effect on strings and nesting is the sum of its pieces, and the
effects of the splits before it give the state it starts in. An object of the array ends
where the nesting comes back to the array's own. Only objects that
a split's border cuts are put together from several splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import scratch, stored

_SPLIT = ("document", "file", "block")


def _count(text: Column, signs: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, signs, ""))).cast("long")


def read_pieces(spark: SparkSession, path: str | list[str], by_folder: bool = False) -> DataFrame:
    """``document, file, block, at, value`` and what a piece does: quotes, and nesting from outside and from inside of a string."""
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"))
    document = F.regexp_replace("file", r"/[^/]*$", "") if by_folder else F.col("file")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = _count(plain, '"') % 2
    outside = lambda text: F.regexp_replace(text, r'"[^"]*("|\z)', "")
    depth = lambda text, ends_outside: _count(text, "{[") - _count(text, "]") - ends_outside.cast("long")
    from_inside = F.regexp_replace(plain, r'^[^"]*("|\z)', "")
    return raw.select(document.alias("document"), "file", "block", "size", "at", "value", quotes.alias("quotes"), depth(outside(plain), quotes == 0).alias("from_out"), depth(outside(from_inside), quotes == 1).alias("from_in"))


def array_objects(spark: SparkSession, path: str | list[str], by_folder: bool = False) -> DataFrame:
    """``document, ordinal, text``: the objects of each file's array in order, from 0.

    With ``by_folder`` the files of a folder, in the order of their names, are
    one document, as a sink of ordered parts writes it. The array may stand on one line or many; strings
    may hold braces, brackets and escapes. What isn't an object is no element;
    an array that is cut off gives its whole objects, and an empty one none.
    """
    with scratch() as keep:
        return keep(stored(_objects(stored(read_pieces(spark, path, by_folder), "pieces")), "objects"))


def _objects(pieces: DataFrame) -> DataFrame:
    within = Window.partitionBy(*_SPLIT).orderBy("at")
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2  # whether a piece starts inside a string if its split starts outside
    step = lambda inside: F.when(inside == 0, F.col("from_out")).otherwise(F.col("from_in"))
    length = F.octet_length("value") + 1
    moves = pieces.withColumn("length", length).drop("value").withColumn("odd", odd).groupBy(*_SPLIT).agg(F.max("size").alias("size"), F.sum("length").alias("length"), F.sum("quotes").alias("quotes"), F.sum(step(F.col("odd"))).alias("from_out"), F.sum(step(1 - F.col("odd"))).alias("from_in"))
    # One row a split from here on, of one document at a time.
    splits = Window.partitionBy("document").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = moves.withColumn("inside", F.coalesce(F.sum("quotes").over(splits), F.lit(0)) % 2)
    # The last piece of a file that doesn't end with a brace has none behind it.
    of_file = Window.partitionBy("document", "file")
    starts = starts.withColumn("unclosed", (F.sum("length").over(of_file) > F.col("size")) & (F.col("block") == F.max("block").over(of_file)))
    not_there = F.when(F.col("unclosed") & ((F.col("inside") + F.col("quotes")) % 2 == 0), 1).otherwise(0)
    starts = stored(starts.withColumn("depth", F.coalesce(F.sum(step(F.col("inside")) + not_there).over(splits), F.lit(0))).select(*_SPLIT, "inside", "depth", "unclosed"), "splits")

    begins = (odd + F.col("inside")) % 2
    at = pieces.join(starts.hint("merge"), list(_SPLIT)).withColumn("begins", begins)
    at = at.withColumn("upto", F.col("depth") + F.sum(step(F.col("begins"))).over(within))
    ends = ((F.col("begins") + F.col("quotes")) % 2 == 0) & (F.col("upto") == 1) & ~(F.col("unclosed") & F.lead("at").over(within).isNull())
    at = at.withColumn("ends", ends.cast("long")).withColumn("nth", F.coalesce(F.sum("ends").over(ahead), F.lit(0)))
    text = lambda sorted_parts: F.array_join(F.transform(sorted_parts, lambda p: p["value"]), "")
    parts = at.groupBy(*_SPLIT, "nth").agg(F.sort_array(F.collect_list(F.struct("at", F.concat("value", F.lit("}")).alias("value")))).alias("p"), F.max("ends").alias("whole"))
    parts = stored(parts.select(*_SPLIT, "nth", text(F.col("p")).alias("value"), "whole"), "parts")

    counts = parts.groupBy(*_SPLIT).agg(F.sum("whole").alias("n"))
    firsts = stored(counts.select(*_SPLIT, F.coalesce(F.sum("n").over(splits), F.lit(0)).alias("first")), "firsts")
    numbered = parts.join(firsts.hint("merge"), list(_SPLIT)).withColumn("ordinal", F.col("first") + F.col("nth"))
    border = (F.col("whole") == 0) | (F.col("nth") == 0)
    cut = numbered.filter(border).groupBy("document", "ordinal").agg(F.sort_array(F.collect_list(F.struct("file", "block", "value"))).alias("p"), F.max("whole").alias("whole")).filter("whole = 1")
    every = numbered.filter(~border).select("document", "ordinal", "value").unionByName(cut.select("document", "ordinal", text(F.col("p")).alias("value")))
    return every.select("document", "ordinal", F.regexp_replace("value", r"^[^{]*", "").alias("text"))


def read_array(spark: SparkSession, path: str | list[str], schema: str, by_folder: bool = False) -> DataFrame:
    """``document, ordinal`` and the fields of ``schema`` of each object; of one that can't be parsed they are null."""
    return array_objects(spark, path, by_folder).select("document", "ordinal", F.from_json("text", schema).alias("e")).select("document", "ordinal", "e.*")
