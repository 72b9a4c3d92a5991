"""Bounded samples of labelled text for fitting a classifier on the driver."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small, stored

#: Bytes of text that a sample may hold together.
SAMPLE_BYTES = 32 << 20


def sample_labelled(docs: DataFrame, labelled: DataFrame, per_class: int, limit: int, seed: int, limit_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """``(doc_id, label, text)``, whole texts, of at most ``per_class`` documents a class.

    ``labelled`` has doc_id and label. At most ``limit`` documents are taken in
    all, and ``limit_bytes`` of text: a text that would pass this is left out.
    Which rows are taken depends only on the seed, the ids and the lengths: a
    class' ids with the smallest hashes. A class is ranked by hash share times
    class size, so no task holds all of a class, and only chosen texts move.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    by_share = F.pmod(order, F.lit(1 << 40))
    chosen = labelled.select("doc_id", "label").filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).distinct()
    sizes = stored(chosen.groupBy("label").agg(F.count("*").alias("n")), "classes")
    rank = by_share / F.lit(float(1 << 40)) * F.col("n")  # about the id's place in its class
    near = chosen.join(small(sizes), "label").select("doc_id", "label", rank.alias("rank"), order.alias("order")).filter(F.col("rank") <= 2.0 * per_class + 200)
    ranked = near.orderBy("rank", "order", "doc_id", "label").limit(2 * limit).collect()
    dropped(sizes)
    taken: Counter = Counter()
    ids = []
    for r in ranked:
        if taken[r["label"]] < per_class and len(ids) < limit:
            taken[r["label"]] += 1
            ids.append((r["doc_id"], r["label"]))
    if not ids:
        return []
    spark = docs.sparkSession
    own = F.broadcast(spark.createDataFrame(sorted({(i,) for i, _ in ids}), "doc_id long"))
    sizes_of: dict[int, int] = {}
    for r in docs.join(own, "doc_id").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect():
        sizes_of[r["doc_id"]] = sizes_of.get(r["doc_id"], 0) + r["n"]
    held, fitting = 0, []
    for i, label in ids:
        if held + sizes_of.get(i, 0) <= limit_bytes:
            held += sizes_of.get(i, 0)
            fitting.append((i, label))
    few = spark.createDataFrame(fitting, "doc_id long, label string")
    rows = docs.join(F.broadcast(few), "doc_id").select("doc_id", "label", "text")
    return sorted((r["doc_id"], r["label"], r["text"] or "") for r in rows.collect())
