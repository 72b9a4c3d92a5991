"""Helpers shared by the text operators: tables, shared scratch space, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from ..scratch import dropped, scratch, shared_dir, stored, stored_bytes  # noqa: F401 (the operators take them from here)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A side of a join is broadcast only when its rows take at most this in memory.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: 8 bytes a value, and texts and arrays by their lengths."""
    size = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            each = F.transform(f"`{f.name}`", lambda x, t=f.dataType.elementType: (F.octet_length(x) if isinstance(t, StringType) else F.lit(0)) + 16)
            size += F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(16))), F.lit(0))
    return size


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if its rows are few enough.

    Files beyond the limit are too large in memory as well; of others the rows
    are measured. Beyond the limit the join that uses it shuffles both sides.
    """
    if stored_bytes(df) > limit:
        return df
    held = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else: ``lower`` where that is the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """The columns an operator reads, so that others can't clash with its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


class Remembered:
    """Decorates a function whose results are kept for later calls with the same arguments.

    Unlike ``functools.cache`` it travels to executors by value, as the
    package does; what it remembers stays behind.
    """

    def __init__(self, make: Callable):
        self.make, self.made = make, {}

    def __call__(self, *args):
        if args not in self.made:
            self.made[args] = self.make(*args)
        return self.made[args]

    def __reduce__(self):
        return Remembered, (self.make,)


def map_texts(rows: DataFrame, make: Callable[[list[str | None]], dict[str, list]], added: str, slice_rows: int = 256) -> DataFrame:
    """``rows`` (whose last column is text) with text replaced by new columns.

    ``make`` gets some texts and returns the columns named in ``added`` (a
    schema string). Arrow batches are handled ``slice_rows`` rows at a time;
    the other columns pass through unchanged, nulls included.
    """
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = StructType([*kept, *StructType.fromDDL(added).fields])
    target = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                b = whole.slice(at, slice_rows)
                new = make(b.column(b.schema.get_field_index("text")).to_pylist())
                arrays = [b.column(b.schema.get_field_index(n)) for n in names]
                arrays += [pa.array(new[f.name], type=target.field(f.name).type) for f in schema.fields[len(names) :]]
                yield pa.RecordBatch.from_arrays([a.cast(t.type) if a.type != t.type else a for a, t in zip(arrays, target, strict=True)], names=target.names)

    return rows.mapInArrow(mapped, schema)
