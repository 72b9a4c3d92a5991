"""Mixing sources to target weights by Poisson replication.

A document of source s is wanted ``rate(s)`` times on average: the source's
target share of the output over its share of the input. How often one document
is repeated is the inverse of the Poisson distribution with that mean, taken at
a uniform number hashed from the seed and the doc_id, so any task computes the
same count at any time. Each document is exploded by its count, and the copies
are dealt out in the order of a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import scratch, small, stored

#: Largest mean inverted in one piece; a larger one is a sum of equal parts.
PART_MEAN = 500.0
#: Exponent of a source's row count in its default target weight.
TEMPERATURE = 0.5


def _uniform(*parts: Column) -> Column:
    """52 bits of an md5 as a number from 0 up to, not including, 1."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _order(*parts: Column) -> Column:
    """60 bits of an md5 as a non-negative integer."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def _cumulated(mean: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ..., far into its tail."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("upto"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["upto"], F.array(F.element_at(acc["upto"], -1) + p)).alias("upto"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["upto"])


def source_rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``source, n, rate``: rows of each source and their mean repetition.

    ``targets`` gives weights by source, sources not in it get none; without
    it a source's weight is its row count to the power ``temperature``. The
    output has as many rows as the input on average.
    """
    counts = stored(docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n")), "sources")
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    rows, weights = counts.agg(F.sum("n"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(weights)) if weights else F.lit(0.0)
    return counts.select("source", "n", (share * F.lit(float(rows or 0)) / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = 7) -> DataFrame:
    """``docs`` repeated to the target weights, in shuffled order.

    Adds n_copies, copy_no (1 to n_copies) and shuffle_key, by which the
    output is range-partitioned and sorted; columns of ``docs`` by these names
    are replaced. A null source is a source; a null doc_id hashes as the empty
    text; rows that share a doc_id share its count. Documents whose count is 0
    leave, as the method has it. An empty table gives an empty one.
    """
    added = ("n_copies", "copy_no", "shuffle_key")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("doc")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int")
    with scratch() as keep:
        rates = keep(stored(source_rates(docs, targets, temperature).select("source", parts.alias("parts"), _cumulated(F.col("rate") / parts).alias("upto")), "rates"))
    ident = F.coalesce(F.col("doc.doc_id").cast("string"), F.lit(""))
    rows = docs.select(doc, F.col("source").cast("string").alias("own_source"))
    one = rows.join(small(rates), rows.own_source.eqNullSafe(rates.source))
    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, part: acc + F.size(F.filter("upto", lambda c: c <= _uniform(F.lit(str(seed)), ident, part.cast("string")))))
    copies = one.select("doc", count.alias("n_copies")).filter("n_copies > 0").select("doc", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    keyed = copies.select("doc.*", "n_copies", "copy_no", _order(F.lit(f"order{seed}"), ident, F.col("copy_no").cast("string")).alias("shuffle_key"))
    assert isinstance(keyed.schema["shuffle_key"].dataType, LongType)
    return keyed.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
