"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document's set holds its distinct 5-word shingles. Documents are linked where
100 * |A & B| >= 75 * |A | B|, and every link is confirmed on the full sets.

1. Documents with equal sets form one class; only its smallest doc_id goes on.
2. A signature of ``HASHES`` minima is read in ``ORDERS`` different orders of its
   places. Each order is sorted; classes that agree in at least its first
   ``LEAST_DEPTH`` values form a region of that order, and neighbours in the
   sort have the longest common prefix.
3. Neighbours are compared first, which joins most of each group.
4. Then each region that still holds several components is searched in full:
   its classes' sets are brought together, and an inverted list of the region's
   shingles gives the overlap of every pair between different components. The
   depth adapts: a region whose sets are too large together is first divided
   by deeper prefixes, which joins most of it. What is then still open is
   searched at the least depth in blocks: the region's largest component is
   dealt out, and the classes outside it meet all of its blocks and each
   other, so no pair is left out.

Links are put out only as long as they join different components, so a group
of n near copies gives in the order of n rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, dropped, map_texts, scratch, small, stored

SHINGLE = 5
SIMILAR = (75, 100)
HASHES = 64
ORDERS = 16
DEPTH = 8
LEAST_DEPTH = 2
#: Orders whose neighbours are all compared in the first round.
CHAINED = 3
#: Shingles of a region's classes that one task holds together.
REGION_SHINGLES = 2_000_000
#: Rows of a region that may meet in one task of a join.
REGION_ROWS = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MUL = (_RNG.integers(1, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
#: Places of the signature in the sequence in which each order reads them.
_SEQUENCE = np.stack([np.concatenate([own, _RNG.permutation(np.setdiff1d(np.arange(HASHES), own))[: DEPTH - len(own)]]) for own in np.arange(ORDERS * 2).reshape(ORDERS, 2) % HASHES])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Words(dict):
    """64-bit hash of each word seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; empty without words."""
    own = (text or "").encode().lower().split()
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, own), np.uint64, n)
    if n < SHINGLE:
        return _mixed((w * _PLACE[:n]).sum(keepdims=True) + _MIX * np.arange(n, n + 1, dtype=np.uint64))
    h = w[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        h += w[k : n - SHINGLE + 1 + k] * _PLACE[k]
    return np.unique(_mixed(h))


def signature(h: np.ndarray) -> np.ndarray:
    """``HASHES`` minima of a set of shingle hashes."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(best, (x[None, at : at + 4096] * _MUL[:, None] + _ADD[:, None]).min(1), out=best)
    return best


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_a and set_b (128 bits that stand for the set), sig."""

    def make(texts: list[str | None]) -> dict[str, list]:
        words = _Words()
        out: dict[str, list] = {"n": [], "set_a": [], "set_b": [], "sig": []}
        for t in texts:
            h = shingles(t, words)
            out["n"].append(len(h))
            out["set_a"].append(int(h.sum().astype(np.int64)) if len(h) else 0)
            out["set_b"].append(int(_mixed(h ^ _MIX).sum().astype(np.int64)) if len(h) else 0)
            out["sig"].append(signature(h).tobytes() if len(h) else None)
        return out

    return map_texts(docs, make, "n long, set_a long, set_b long, sig binary", slice_rows=1024)


def _forest(classes: DataFrame) -> DataFrame:
    """Each class in each order: region, deeper values two by two, rep.

    One order's region is never another's. The rows are sorted as a whole,
    over all tasks, so that no region has to be held in one.
    """
    salt = (np.arange(ORDERS, dtype=np.uint64) * _MIX)[None, :]

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            label = sig[:, _SEQUENCE].astype(np.uint64)  # rows, orders, depth
            two = (label[:, :, 0::2] << np.uint64(32)) | label[:, :, 1::2]
            region = _mixed(two[:, :, 0] + salt)
            rep = np.repeat(np.array(b.column(0)), ORDERS)
            order = np.tile(np.arange(ORDERS, dtype=np.int32), b.num_rows)
            columns = [region.ravel().view(np.int64), order, *(two[:, :, k].ravel().view(np.int64) for k in (1, 2, 3)), rep, np.repeat(np.array(b.column(2)), ORDERS)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["region", "turn", "v1", "v2", "v3", "rep", "n"])

    rows = classes.select("rep", "sig", "n").mapInArrow(orders, "region long, turn int, v1 long, v2 long, v3 long, rep long, n long")
    by = ("region", "v1", "v2", "v3", "rep")
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_beside, "region long, turn int, v1 long, v2 long, v3 long, rep long, n long, before long")


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted stretch with the one before in their region (else themselves).

    Rows that are alone in their region are left out, but where the stretch
    begins or ends, as the region may go on in the stretch beside it. A pair of
    neighbours parted there is not lost: its region is searched later.
    """
    names = ["region", "turn", "v1", "v2", "v3", "rep", "n", "before"]
    held: list[np.ndarray] | None = None  # the last row, until the one after it is known
    ahead: tuple[int, int] | None = None  # region and rep of the row before it

    def row(columns: list[np.ndarray], keep: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in [*columns, before]], names=names)

    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.array(b.column(k)) for k in range(7)]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        region, rep = columns[0], columns[5]
        first = ahead is None
        earlier = np.concatenate([[0 if first else ahead[0]], region[:-1]])
        same = region == earlier
        if first:
            same[0] = False
        before = np.where(same, np.concatenate([[0 if first else ahead[1]], rep[:-1]]), rep)
        keep = same[:-1] | same[1:]
        if first and len(keep):
            keep[0] = True
        yield row([c[:-1] for c in columns], keep, before[:-1])
        held = [c[-1:] for c in columns]
        if len(region) > 1:
            ahead = int(region[-2]), int(rep[-2])
    if held is not None:
        joined = ahead is not None and ahead[0] == held[0][0]
        yield row(held, np.array([True]), np.array([ahead[1]]) if joined else held[5])


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    text = docs.select("doc_id", "text")
    left = pairs.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, sets = _Words(), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                a, b = part.column(0), part.column(1)
                ok = []
                for i, (x, y, z) in enumerate(zip(b.to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if x != last:
                        last, sets = x, shingles(z, words)
                    if linked(shingles(y, words), sets):
                        ok.append(i)
                ok = pa.array(ok, pa.int64())
                yield pa.RecordBatch.from_arrays([a.take(ok), b.take(ok)], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of every node of the edges (a, b): the smallest reachable node.

    Every round each node takes its smallest neighbour as parent; edges move
    to the parents and vanish when they become loops.
    """
    edge = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = stored(edge.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while edge.limit(1).count():
        near = edge.select("a", "b").union(edge.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("least"))
        parent = stored(near.select(F.col("a").alias("child"), F.least("a", "least").alias("parent")), "parents")
        for _ in range(2):
            up = parent.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            higher = stored(parent.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent")), "parents")
            dropped(parent)
            parent = higher
        above = parent.select(F.col("child").alias("comp"), "parent")
        moved = stored(label.join(above, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp")), "labels")
        pa_, pb = parent.select(F.col("child").alias("a"), F.col("parent").alias("to_a")), parent.select(F.col("child").alias("b"), F.col("parent").alias("to_b"))
        left = edge.join(pa_, "a").join(pb, "b").filter("to_a <> to_b")
        fewer = stored(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        for x in (label, edge, parent):
            dropped(x)
        label, edge = moved, fewer
    dropped(edge)
    return label


def _overlapping(comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs that are similar and join components, as few as join all."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    names, inverse = np.unique(comp, return_inverse=True)
    up = np.arange(len(names))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    main = np.bincount(inverse).argmax()
    out = []
    for i in np.flatnonzero(inverse != main):  # pairs within the largest component need no look
        low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        spread = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
        both = np.bincount(owner[spread], minlength=len(sets))
        for j in np.flatnonzero((SIMILAR[1] * both >= SIMILAR[0] * (size + size[i] - both)) & (inverse != inverse[i])):
            x, y = find(inverse[i]), find(inverse[j])
            if x != y:
                up[x] = y
                out.append((int(i), int(j)))
    return out


def _told(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with what ``known`` says of their regions; rows of other regions go.

    ``known`` is stored, with one row and a count ``m`` of rows for each region.
    If it is too large for broadcast, the regions of many rows, which are few,
    are joined apart from the rest, so that no task gets all rows of one.
    """
    side = small(known)
    if side is not known:
        return rows.join(side, "region").drop("m")
    large = stored(known.filter(F.col("m") > REGION_ROWS), "large")
    rest = rows.join(small(large), "region", "left_anti").join(known.filter(F.col("m") <= REGION_ROWS), "region")
    return rows.join(small(large), "region").unionByName(rest).drop("m")


def _open(forest: DataFrame, comp: DataFrame) -> DataFrame:
    """The forest's rows in regions that hold several components."""
    at = forest.join(comp.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    several = at.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).filter("low <> high").select("region", "m")
    return stored(_told(at, stored(several, "several")).select("region", "v1", "v2", "v3", "rep", "comp", "n"), "open")


def _deeper(open_: DataFrame, limit: int) -> DataFrame | None:
    """``region, rep, comp`` with too large regions divided by deeper prefixes; None if there is none.

    What stays too large at full depth is cut into blocks.
    """
    divided = None
    for column in ("v1", "v2", "v3"):
        sizes = stored(open_.groupBy("region").agg(F.sum("n").alias("held")).filter(F.col("held") > limit), "sizes")
        if not sizes.limit(1).count():
            break
        divided = open_.join(small(sizes), "region", "left").withColumn("region", F.when(F.col("held").isNotNull(), F.xxhash64("region", column)).otherwise(F.col("region"))).drop("held")
        open_ = divided = stored(divided, "open")
    if divided is None:
        return None
    sizes = divided.groupBy("region").agg(F.sum("n").alias("held"), F.count("*").alias("m")).filter("m > 1")
    sizes = stored(sizes, "sizes")
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("held") / limit))
    return _told(divided, sizes).select(F.when(F.col("held") > limit, F.xxhash64("region", block)).otherwise(F.col("region")).alias("region"), "rep", "comp")


def _blocks(open_: DataFrame, limit: int) -> DataFrame:
    """``region, rep, comp`` such that every two components of a region meet in full somewhere."""
    per = open_.groupBy("region", "comp").agg(F.sum("n").alias("held"), F.count("*").alias("m"))
    sizes = stored(per.groupBy("region").agg(F.max_by("comp", "held").alias("main"), F.max("held").alias("of_main"), F.sum("held").alias("held"), F.sum("m").alias("m")), "sizes")
    parts = lambda c: F.greatest(F.lit(1), F.ceil(c / limit)).cast("int")
    fits = F.col("held") <= limit
    sized = _told(open_, sizes).withColumn("mains", F.when(fits, 1).otherwise(parts(F.col("of_main")))).withColumn("others", F.when(fits, 1).otherwise(parts(F.col("held") - F.col("of_main"))))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    main = F.transform(all_of("others"), lambda j: F.xxhash64("region", F.lit(0), place("mains"), j))
    other = F.concat(
        F.transform(all_of("mains"), lambda k: F.xxhash64("region", F.lit(0), k, place("others"))),
        F.transform(all_of("others"), lambda j: F.xxhash64("region", F.lit(1), F.least(j, place("others")), F.greatest(j, place("others")))),
    )
    whole = F.array(F.col("region"))
    return sized.select(F.explode(F.when(fits, whole).when(F.col("comp") == F.col("main"), main).otherwise(other)).alias("region"), "rep", "comp")


def _across(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join different components, found within each region."""
    placed = stored(placed, "placed")
    wanted = stored(placed.select(F.col("rep").alias("doc_id")).distinct(), "wanted")

    def whole(texts: list[str | None]) -> dict[str, list]:
        words = _Words()
        return {"own": [shingles(t, words).tobytes() for t in texts]}

    sets = map_texts(docs.join(small(wanted), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text"), whole, "own binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            comp = np.array([c for _, c, _ in held])
            if len(held) > 1 and not (comp == comp[0]).all():
                found = _overlapping(comp, [np.frombuffer(s, np.uint64) for _, _, s in held])
                a, b = np.array([held[i][0] for i, _ in found], np.int64), np.array([held[j][0] for _, j in found], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for k, r, c, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if k != key:
                    yield from flush()
                    key, held = k, []
                held.append((r, c, x))
        yield from flush()

    ordered = placed.join(sets, "rep").select("region", "rep", "comp", "own").repartition("region").sortWithinPartitions("region")
    return ordered.mapInArrow(search, "a long, b long").distinct()


def _joined(comp: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Components with the links found, once these are confirmed on the full sets."""
    pairs = stored(found.filter("a <> b").distinct(), "pairs")
    if not pairs.limit(1).count():
        return comp
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    more = stored(_confirmed(pairs, docs.join(small(wanted), "doc_id", "left_semi")), "links")
    joined = more.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("to_a")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("to_b")), "b", "left")
    lifted = components(joined.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")))
    up = lifted.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
    old = comp.join(up, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"))
    return stored(old.unionByName(lifted.join(comp, "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Texts without words, nulls among them, have empty sets and are linked with
    nothing. Rows that share a doc_id count as one document. A row without a
    doc_id is linked with nothing: its component is null, and it is kept.
    Whole texts are read, however long; an empty table gives an empty one.
    """
    with scratch() as keep:
        return _grouped(documents(docs), region_shingles, keep)


def _grouped(docs: DataFrame, region_shingles: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    sig = stored(_signatures(docs), "signatures")
    known = sig.filter("n > 0 and doc_id is not null")
    sets = known.groupBy("set_a", "set_b", "n").agg(F.min(F.struct("doc_id", "sig")).alias("one"))
    classes = stored(sets.select("set_a", "set_b", "n", F.col("one.doc_id").alias("rep"), F.col("one.sig").alias("sig")), "classes")
    forest = stored(_forest(classes), "forest")
    beside = forest.filter("before <> rep").select(F.least("rep", "before").alias("a"), F.greatest("rep", "before").alias("b"), "turn")
    beside = beside.groupBy("a", "b").agg(F.count("*").alias("orders"), F.min("turn").alias("first"))
    # Each class with the neighbour it meets in most orders, and whole chains.
    ends = beside.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "orders", "first")
    best = ends.groupBy("e.x").agg(F.max(F.struct("orders", "e.y")).alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b"))
    first = stored(best.union(beside.filter(F.col("first") < CHAINED).select("a", "b")).distinct(), "neighbours")
    wanted = stored(first.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    link = stored(_confirmed(first, docs.join(small(wanted), "doc_id", "left_semi")), "links")
    twins = sig.filter("doc_id is not null and n > 0").join(classes.select("set_a", "set_b", "n", "rep"), ["set_a", "set_b", "n"]).select("doc_id", "rep")
    repeated = twins.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).join(classes.select(F.col("rep").alias("b")), "b", "left_semi").select("a", "b")
    comp = components(link.union(repeated))
    open_ = _open(forest, comp)
    if (deeper := _deeper(open_, region_shingles)) is not None:
        comp = _joined(comp, _across(deeper, docs), docs)
        open_ = _open(forest, comp)
    comp = _joined(comp, _across(_blocks(open_, region_shingles), docs), docs)
    own = twins.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    comp = comp.select(F.col("node").alias("rep"), "comp")
    named = own.join(comp, "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    named = small(keep(stored(named.filter("component_id <> doc_id"), "named")))
    sizes = keep(stored(sig.select("doc_id", F.col("n").alias("n_shingles")), "sizes"))
    out = sizes.join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def without_near_duplicates(docs: DataFrame, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """``docs`` with the document of each group that ``near_duplicates`` keeps."""
    with scratch() as keep:
        leave = near_duplicates(docs, region_shingles).filter("not kept").select(F.col("doc_id").alias("its_id")).distinct()
        leave = small(keep(stored(leave, "leave")))
    return docs.join(leave, docs["doc_id"].cast("long") == leave["its_id"], "left_anti")
