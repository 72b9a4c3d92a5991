"""Exact deduplication by deterministic block naming.

Every text is cut into fixed-size blocks. Equal blocks get one integer name,
different blocks different names: the distinct blocks are sorted, and a block's
name is its place. Adjacent names are then paired, the distinct pairs sorted
and named the same way, and so on until each text has one name. Two texts of
one length have the same last name exactly if they are equal; no step relies
on a hash being free of collisions.

Blocks are sorted by a 64-bit digest and then, where several blocks share a
digest, by their bytes, so that only the digest has to travel with a document.
Each block's bytes are read once, to prove which digests stand for one block.

A row with a block or pair that occurs nowhere else has no copy, and leaves
the recursion there. Rows that are equal in doc_id and text go through it as
one, with their number, so that they are copies of each other at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, dropped, scratch, small, stored

BLOCK_BYTES = 1024


def _named(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` in sorted order, each with its place as ``name``.

    The range partitions follow each other in the order of the keys, so the
    place (partition, row) rises with the key. The result is stored: a name is
    made once and never computed again.
    """
    ordered = counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _block_names(docs: DataFrame, blocks: Column) -> DataFrame:
    """Names of distinct blocks: digest, first (bytes or null), n, name.

    ``bytes`` is null where the digest alone tells the block.
    """
    at = docs.select(F.explode(blocks).alias("block")).select(F.xxhash64("block").alias("digest"), "block")
    by_digest = stored(at.groupBy("digest").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count("*").alias("n")).select("digest", "n", (F.col("low") != F.col("high")).alias("mixed")), "digests")
    sole = by_digest.filter(~F.col("mixed")).select("digest", F.lit(None).cast("binary").alias("bytes"), "n")
    counted = sole
    if by_digest.filter("mixed").limit(1).count():
        mixed = by_digest.filter("mixed").select("digest")
        counted = sole.unionByName(at.join(mixed, "digest").groupBy("digest", F.col("block").alias("bytes")).agg(F.count("*").alias("n")))
    names = _named(counted, ["digest", "bytes"])
    dropped(by_digest)
    return names


def text_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, sha`` of the texts that may have copies, with their identity.

    ``docs`` has doc_id, sha (of the text) and raw (its bytes). Returns
    doc_id, sha, level, name, once for rows that are equal in doc_id and text:
    equal (level, name) exactly for equal texts. Texts not in the result are
    those of a single row.
    """
    raw = F.col("raw")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.length(raw) / F.lit(float(block_bytes)))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))
    names = _block_names(docs, cut)
    mixed = names.filter(F.col("bytes").isNotNull()).limit(1).count() > 0
    at = docs.select("doc_id", "sha", F.posexplode(cut).alias("place", "block"))
    if mixed:
        shared_digest = names.filter(F.col("bytes").isNotNull()).select("digest").distinct()
        at = at.withColumn("digest", F.xxhash64("block")).join(shared_digest.withColumn("mixed", F.lit(True)), "digest", "left")
        at = at.select("doc_id", "sha", "place", "digest", F.when(F.col("mixed"), F.col("block")).alias("bytes"))
        on = (F.col("l.digest") == F.col("r.digest")) & F.col("l.bytes").eqNullSafe(F.col("r.bytes"))
    else:
        at = at.select("doc_id", "sha", "place", F.xxhash64("block").alias("digest"))
        on = F.col("l.digest") == F.col("r.digest")
    level = 0
    row = at.alias("l").join(names.alias("r"), on).groupBy("l.doc_id", "l.sha", "l.place", "r.name", "r.n").agg(F.count("*").alias("copies"))
    done: DataFrame | None = None
    spent: list[DataFrame] = [names]
    while True:
        row = stored(row, "level")
        for x in spent:
            dropped(x)
        spent = [row]
        per_doc = row.groupBy("doc_id", "sha").agg(F.min("n").alias("least"), F.max("place").alias("last"), F.min("name").alias("name"))
        per_doc = stored(per_doc.filter("least > 1"), "shared")
        whole = per_doc.filter("last = 0").select("doc_id", "sha", F.lit(level).alias("level"), "name")
        done = whole if done is None else done.unionByName(whole)
        longer = per_doc.filter("last > 0").select("doc_id", "sha", "last")
        if not longer.limit(1).count():
            dropped(row)
            return done
        part = row.join(longer, [row.doc_id.eqNullSafe(longer.doc_id), row.sha == longer.sha])
        pair = part.groupBy(row.doc_id, row.sha, F.floor(F.col("place") / 2).cast("int").alias("half")).agg(F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"), F.max("copies").alias("copies"))
        pair = stored(pair.withColumnRenamed("half", "place"), "pairs")
        names = _named(pair.groupBy("a", "b").agg(F.sum("copies").alias("n")), ["a", "b"])
        row = pair.join(names, ["a", "b"]).select("doc_id", "sha", "place", "name", "n", "copies")
        spent += [pair, names]
        level += 1


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. A null text counts
    as empty, so nulls and empty texts are copies of each other. A null doc_id
    is below every other. Rows that repeat one doc_id and text are counted
    each in group_size and share the flag ``kept``. No rows give no rows;
    columns other than doc_id and text are not read.
    """
    docs = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("raw"))
    light = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    with scratch() as keep:
        ids = text_identities(rows, block_bytes)
        one = light.join(ids, [light.doc_id.eqNullSafe(ids.doc_id), light.text_sha256 == ids.sha], "left")
        one = keep(stored(one.select(light.doc_id, "text_sha256", "level", "name"), "identities"))
    groups = one.filter("name is not null").groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    shared = one.filter("name is not null").join(groups, ["level", "name"])
    alone = one.filter("name is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    both = shared.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(alone)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one row of each text: the one ``exact_dedup`` keeps.

    Of rows that repeat a doc_id and text the one stays whose columns, written
    as JSON, sort first. A null text is equal to an empty one.
    """
    sha = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)

    def joined(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
        side = small(named)  # columns are taken by frame, as ``docs`` may have others of these names
        return rows.join(side, docs["doc_id"].cast("long").eqNullSafe(side["its_id"]) & (sha == side["its_sha"]), how)

    with scratch() as keep:
        found = exact_dedup(docs, block_bytes).filter("group_size > 1").select(F.col("doc_id").alias("its_id"), F.col("text_sha256").alias("its_sha"), "kept")
        found = stored(found, "copies")
        leave = keep(stored(found.filter("not kept").select("its_id", "its_sha").distinct(), "leave"))
        repeated = keep(stored(found.filter("kept").groupBy("its_id", "its_sha").count().filter("count > 1").select("its_id", "its_sha"), "repeated"))
    left = joined(docs, leave, "left_anti")
    if not repeated.limit(1).count():
        return left
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    first = joined(left, repeated, "left_semi").groupBy(docs["doc_id"].cast("long").alias("own_id"), sha.alias("own_sha")).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("row"))
    return joined(left, repeated, "left_anti").unionByName(first.select("row.*"))
