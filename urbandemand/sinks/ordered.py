"""Documents of any size, written by many tasks in the order of their items.

A document is a folder of text files; put one after the other by name they are
the document. Items are dealt to tasks by ranges of their order, and the head
and the tail are rows that sort before and after all of them, so that no task
and no row holds more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_parts(items: DataFrame, document: str, order: list[str], text: Column, head: str, tail: str, documents: DataFrame | None = None) -> DataFrame:
    """``document, rank, <order>, value``: lines of each document, sorted into tasks by document and place.

    ``order`` has to tell the items of a document apart. ``documents`` (one
    column of the same name) may name more of them, which are empty ones.
    """
    first = items.groupBy(document).agg(F.min(F.struct(*order)).alias("_first"))
    lead = F.when(F.struct(*order) == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    body = items.join(first.hint("merge"), document).select(document, F.lit(1).alias("rank"), *order, F.concat(lead, text).alias("value"))
    names = items.select(document) if documents is None else items.select(document).unionByName(documents.select(document))
    none = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in order]
    frame = names.distinct().select(document, F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit(head).alias("value")), F.struct(F.lit(2).alias("rank"), F.lit(tail).alias("value")))).alias("f"))
    every = body.unionByName(frame.select(document, F.col("f.rank").alias("rank"), *none, F.col("f.value").alias("value")))
    keys = [document, "rank", *order]
    return every.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_ordered(items: DataFrame, path: str, document: str, order: list[str], text: Column, head: str = "[", tail: str = "]", documents: DataFrame | None = None, compression: str = "none") -> None:
    """A folder ``<document>=<name>`` for each document; those of other documents stay."""
    lines = ordered_parts(items, document, order, text, head, tail, documents).select(document, "value")
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(document).text(path)


def feature_text(kind: Column, coordinates: Column, properties: Column) -> Column:
    """A feature as JSON; ``coordinates`` is JSON already."""
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"))


def write_features(features: DataFrame, path: str, order: list[str], compression: str = "none") -> None:
    """A feature collection for each city, features in ``order`` (of tiles and of features in them, say).

    ``features`` has city, kind, coordinates (JSON) and properties (a map or struct).
    """
    text = feature_text(F.col("kind"), F.col("coordinates"), F.col("properties"))
    write_ordered(features, path, "city", order, text, '{"type":"FeatureCollection","features":[', "]}", compression=compression)
