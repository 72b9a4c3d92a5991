"""Prefix tries of conversations.

Turns become digests with their byte counts; equal rebuilt conversations become
one path with its number of members. Paths are dealt to tasks by a hash of the
digest of their first turn, and each task builds its subtries with dictionaries
in ``applyInPandas``, in postorder and without recursion. A subtrie of more turns than one task should
hold is not built there: the turns that all its paths begin with become a chain
of nodes, and its paths are dealt again by the turn that follows, and so on. What
the tasks tell of their tops is summed up to the chains above, from the deepest
to the root.

A conversation is one row of digests, 40 bytes a turn. The digest of a node's
ending members is taken over their ids as they come sorted, without holding
them; one node's ids are one task's, as SHA-256 takes them one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_crc, scratch, small, stored

#: Turns of a subtrie that one task builds.
SUBTRIE_TURNS = 50_000
#: Conversations that share a first part, and the longest such part is BLOCK_TURNS - 1.
BLOCK, BLOCK_TURNS = 5, 9
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODES = "unit string, parent string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, path``: each conversation's turns (digest, bytes) after its first ones were replaced by its block's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(conv.alias("conv_id"), (conv - conv % BLOCK).alias("base"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    # The role's length before it makes the pair's text unambiguous.
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turn = F.struct("turn", "role", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    dealt = rows.filter("conv_id is not null").select("base", "conv_id", turn.alias("t")).repartition("base")
    own = dealt.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("base", "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, BLOCK_TURNS))).over(Window.partitionBy("base"))
    h = (id_crc(F.col("conv_id")) % BLOCK_TURNS).cast("int")
    none = F.slice("own", 1, 0)
    path = F.concat(F.slice(F.coalesce(F.col("first"), none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return own.withColumn("first", first).withColumn("h", h).select("conv_id", path.alias("path"))


def distinct_paths(convs: DataFrame) -> DataFrame:
    """``n, smallest, ends_sha256, path``: each different path with its members."""
    ident = F.sha2(F.array_join(F.transform("path", lambda t: F.hex(t["digest"])), ""), 256)
    convs = stored(convs.select("conv_id", "path", ident.alias("path_id")), "convs")
    one = convs.groupBy("path_id").agg(F.count("*").alias("n"), F.min("conv_id").alias("smallest"), F.first("path").alias("path"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            done = []
            for path, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = path, hashlib.sha256(b"%d" % conv)
                else:
                    sha.update(b",%d" % conv)
            yield pa.RecordBatch.from_pylist([{"path_id": p, "ends_sha256": s} for p, s in done], schema=_ENDS)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([{"path_id": now, "ends_sha256": sha.hexdigest()}], schema=_ENDS)

    told = convs.select("path_id", "conv_id").repartition("path_id").sortWithinPartitions("path_id", "conv_id").mapInArrow(ends, "path_id string, ends_sha256 string")
    return one.join(told.hint("merge"), "path_id").select("n", "smallest", "ends_sha256", "path")


_ENDS = pa.schema([("path_id", pa.string()), ("ends_sha256", pa.string())])


def subtries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries of some units; a row is a path from its unit's top on."""
    up: list[int] = []  # of each node its parent here, -1 for a top
    down: list[dict[bytes, int]] = []
    size: list[int] = []
    depth: list[int] = []
    members: list[int] = []
    smallest: list[int] = []
    ends: list[str] = []
    tops: dict[str, int] = {}
    above: dict[str, str] = {}

    def made(parent: int, d: int, n_bytes: int) -> int:
        up.append(parent)
        down.append({})
        size.append(n_bytes)
        depth.append(d)
        members.append(0)
        smallest.append(1 << 63)
        ends.append(_EMPTY)
        return len(up) - 1

    for unit, parent, top, n, least, end, digests, lengths in zip(*(pdf[c] for c in ("unit", "parent", "top_depth", "n", "smallest", "ends_sha256", "digests", "lengths"))):
        node = -1
        for k, (digest, n_bytes) in enumerate(zip(digests, lengths)):
            known, key = (tops, unit) if k == 0 else (down[node], bytes(digest))
            at = known.get(key)
            if at is None:
                at = known[key] = made(node, top + k, int(n_bytes))
            node = at
            members[node] += n
            smallest[node] = min(smallest[node], least)
        ends[node] = end
        above[unit] = parent
    leaves, saved = [0] * len(up), [0] * len(up)
    for top in tops.values():
        stack = [(top, iter(down[top].values()))]
        while stack:
            node, left = stack[-1]
            child = next(left, None)
            if child is not None:
                stack.append((child, iter(down[child].values())))
                continue
            stack.pop()
            leaves[node] = max(1, sum(leaves[c] for c in down[node].values()))
            saved[node] = (members[node] - 1) * size[node] + sum(saved[c] for c in down[node].values())
    units: list[str | None] = [None] * len(up)
    for unit, top in tops.items():
        units[top] = unit
    return pd.DataFrame({
        "unit": units, "parent": [above[u] if u is not None else None for u in units], "top": [u is not None for u in units], "conv_id": smallest, "depth": depth,
        "parent_conv_id": pd.array([smallest[p] if p >= 0 else None for p in up], dtype="Int64"), "n_convs": members, "n_children": [len(c) for c in down], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends,
    })


def prefix_trie(conversations: DataFrame, subtrie_turns: int = SUBTRIE_TURNS) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in order of turn (null first), those that tie in order of role
    and a digest of the text; each row is a turn, repeated ones too. A null role or text
    counts as empty. Rows without conv_id belong to no conversation and are
    left out. An empty table has no node, not even the root.
    """
    with scratch() as keep:
        return keep(stored(_nodes(stored(distinct_paths(rebuilt(conversations)), "paths"), subtrie_turns), "trie"))


def _nodes(paths: DataFrame, limit: int) -> DataFrame:
    spark = paths.sparkSession
    no_text = F.lit(None).cast("string")
    over = stored(spark.range(1).select(F.lit("").alias("unit"), no_text.alias("parent"), F.lit(0).alias("top_depth"), F.lit(0).alias("low"), F.array(F.lit(0).cast("long")).alias("chain")), "units")
    rows = paths.select(F.lit("").alias("unit"), F.lit(0).alias("low"), "n", "smallest", "ends_sha256", "path")
    upper, ending, built = [over], [], []
    while True:
        ending.append(rows.filter(F.size("path") == F.col("low")).select("unit", "n", "smallest", "ends_sha256"))
        turn = F.element_at("path", F.col("low") + 1)
        key = F.sha2(F.concat("unit", F.hex(turn["digest"])), 256)
        down = stored(rows.filter(F.size("path") > F.col("low")).select(key.alias("unit"), F.col("unit").alias("parent"), (F.col("low") + 1).alias("top_depth"), "n", "smallest", "ends_sha256", "path"), "dealt")
        turns = F.sum(F.size("path") - F.col("top_depth") + 1)
        large = stored(down.groupBy("unit").agg(turns.alias("turns")).filter(F.col("turns") > limit).select("unit"), "large")
        if large.isEmpty():
            built.append(down)
            break
        built.append(down.join(small(large), "unit", "left_anti").select(*down.columns))
        again = down.join(small(large), "unit", "left_semi")
        over = stored(_chains(again.groupBy("unit", "parent", "top_depth").agg(F.min("path").alias("a"), F.max("path").alias("b"))), "units")
        upper.append(over)
        rows = stored(again.drop("parent", "top_depth").join(small(over).select("unit", "low"), "unit"), "again")
    every = reduce(DataFrame.unionByName, built)
    total = every.agg(F.sum(F.size("path") - F.col("top_depth") + 1)).first()[0] or 0
    rest = F.slice("path", F.col("top_depth"), F.size("path"))
    dealt = every.select(
        F.pmod(F.xxhash64("unit"), F.lit(max(1, -(-total // limit)))).alias("bucket"), "unit", "parent", "top_depth", "n", "smallest", "ends_sha256",
        F.transform(rest, lambda t: t["digest"]).alias("digests"), F.transform(rest, lambda t: t["bytes"]).alias("lengths"),
    )
    low = stored(dealt.groupBy("bucket").applyInPandas(subtries, _NODES), "nodes")
    told = low.filter("top").select("parent", "conv_id", "n_convs", "n_leaves", "saved_tokens")
    found = [low]
    for over, ends in zip(reversed(upper), reversed(ending)):
        high = stored(_above(over, ends, told), "nodes")
        found.append(high)
        told = told.unionByName(high.filter("top").select("parent", "conv_id", "n_convs", "n_leaves", "saved_tokens"))
    nodes = reduce(DataFrame.unionByName, found)
    above = stored(reduce(DataFrame.unionByName, found[1:]).filter("top").select(F.col("unit").alias("_unit"), F.col("conv_id").alias("_conv")), "above")
    of = nodes.join(small(above), F.col("parent") == F.col("_unit"), "left")
    return of.select("conv_id", "depth", F.when(F.col("top"), F.col("_conv")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _above(over: DataFrame, ends: DataFrame, told: DataFrame) -> DataFrame:
    """The nodes of chains, from what is told of the tops below and the paths that end at their low ends."""
    kids = told.groupBy(F.col("parent").alias("unit")).agg(F.sum("n_convs").alias("kn"), F.min("conv_id").alias("kc"), F.count("*").alias("kk"), F.sum("n_leaves").alias("kl"), F.sum("saved_tokens").alias("ks"))
    own = ends.select("unit", F.col("n").alias("en"), F.col("smallest").alias("ec"), "ends_sha256")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    at = over.join(kids, "unit", "left").join(own, "unit", "left").withColumn("n_convs", zero("kn") + zero("en")).filter("n_convs > 0")
    row = at.select("*", F.posexplode("chain").alias("i", "n_bytes")).withColumn("depth", (F.col("top_depth") + F.col("i")).cast("long"))
    below = F.sum("n_bytes").over(Window.partitionBy("unit").orderBy(F.desc("depth")))
    lowest = F.col("depth") == F.col("low")
    conv = F.least("kc", "ec")
    return row.select(
        "unit", F.when(F.col("i") == 0, F.col("parent")).alias("parent"), (F.col("i") == 0).alias("top"), conv.alias("conv_id"), "depth", F.when(F.col("i") > 0, conv).alias("parent_conv_id"), "n_convs",
        F.when(lowest, zero("kk")).otherwise(1).alias("n_children"), F.greatest(zero("kl"), F.lit(1)).alias("n_leaves"), (zero("ks") + (F.col("n_convs") - 1) * below).alias("saved_tokens"),
        F.when(lowest, F.coalesce("ends_sha256", F.lit(_EMPTY))).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )


def _chains(units: DataFrame) -> DataFrame:
    """``low``: how many turns all paths of a unit share, as the least and the largest do; ``chain``: bytes of those from its top on."""
    n = F.least(F.size("a"), F.size("b"))
    differ = F.array_min(F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("a", i) != F.element_at("b", i)))
    at = units.withColumn("low", F.coalesce(differ - 1, n))
    return at.select("unit", "parent", "top_depth", "low", F.transform(F.slice("a", F.col("top_depth"), F.col("low") - F.col("top_depth") + 1), lambda t: t["bytes"]).alias("chain"))
