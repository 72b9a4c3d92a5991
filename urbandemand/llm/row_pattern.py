"""Row pattern matching: ``A (D+ U+)+ P`` over each client's clicks in order of time.

Every row can start a match, so matches overlap, and what a start finds
depends only on the rows after it. All rows are dealt to tasks by ranges of
(client, time, id), so one client spreads over as many tasks as its rows need.
A task cuts its rows into segments: a row that can be neither D nor U, then the
rows down and up that follow it. Within a segment all starts share the end of
the last rise. Which row ends a match as P is found in a max segment tree over
the cents of the goal rows: for all starts of a batch at once, the tree is
climbed and descended to the first or last goal row inside the start's run
bounds that has at least the cents of its A.

Where a segment goes on in the next task, its rows go there as a piece of their
own: tails meet the heads of following tasks, twice as many each round, until
each segment is whole. Pieces are as long as the segments at the tasks' borders.
A match's digest takes its labels one by one, which is the only thing here that
grows faster than the rows: with the square of a segment's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import before, joined_to
from .common import scratch, stored

#: Minutes after the previous row within which a row still belongs to a match.
GAP_MINUTES = 30
#: What a null, not-a-number or larger value in cents fits: no letter.
LARGEST_VALUE = 9e16
#: Which P ends a match: "optional" has ``P?``, "last" a P that greedy matching backtracks to,
#: "first" the one that reluctant matching stops at.
GOALS = ("optional", "last", "first")

_NONE = np.iinfo(np.int64).min
_LETTERS = np.frombuffer(b"xDU", np.uint8)
_DOWN, _UP = 1, 2


@dataclass
class Rows:
    """Consecutive rows. ``code``: 0 for no kind or an error, 2 for a click, 1 for another; plus 4 where there is a value."""

    client: np.ndarray
    ts: np.ndarray
    ident: np.ndarray
    cents: np.ndarray
    code: np.ndarray

    def __len__(self) -> int:
        return len(self.ident)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.client, self.ts, self.ident, self.cents, self.code

    def __getitem__(self, at: slice) -> Rows:
        return Rows(*(x[at] for x in self.arrays()))

    def __add__(self, other: Rows) -> Rows:
        return Rows(*(np.concatenate(x) for x in zip(self.arrays(), other.arrays())))

    def packed(self) -> bytes:
        return np.stack(self.arrays()).tobytes()

    @classmethod
    def unpacked(cls, raw: bytes | None) -> Rows:
        return cls(*np.frombuffer(raw or b"", np.int64).reshape(5, -1))

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Rows:
        return cls(*(np.asarray(b.column(c).cast(pa.int64())).astype(np.int64) for c in ("client_id", "ts", "click_id", "cents", "code")))


def labels(r: Rows, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of D (1), U (2) or neither (0) each row fits after the one before it, and whether it follows it in time.

    The first row has none before it.
    """
    near, label = np.zeros(len(r), bool), np.zeros(len(r), np.int8)
    if len(r) > 1:
        near[1:] = (r.client[1:] == r.client[:-1]) & (r.ts[1:] - r.ts[:-1] <= gap)
        fits = near[1:] & (r.code[1:] >= 5) & (r.code[:-1] >= 4)
        label[1:] = np.where(fits, np.where(r.cents[1:] < r.cents[:-1], _DOWN, np.where(r.cents[1:] > r.cents[:-1], _UP, 0)), 0)
    return label, near


class MaxTree:
    """Maxima over blocks of 1, 2, 4, ... places; searches run for many bounds at once."""

    def __init__(self, values: np.ndarray) -> None:
        size = 1 << max(0, (len(values) - 1).bit_length())
        self.levels = [np.concatenate([values, np.full(size - len(values), _NONE, np.int64)])]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).max(axis=1))

    def last(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place from low to high whose value is at least ``least`` and not none; -1 if there is none."""
        out = np.full(len(low), -1, np.int64)
        todo = np.flatnonzero((low <= high) & (low < len(self.levels[0])))
        at, level = np.minimum(high[todo], len(self.levels[0]) - 1), np.zeros(len(todo), np.int64)
        least = np.maximum(least, _NONE + 1)
        # Climb: a block that ends where the search has come to, and lies inside or holds the answer.
        while len(todo):
            hit = np.zeros(len(todo), bool)
            for k in np.unique(level):
                here = level == k
                hit[here] = self.levels[k][at[here]] >= least[todo[here]]
            found, place = todo[hit], self._descended(level[hit], at[hit], least[todo[hit]])
            inside = place >= low[found]
            out[found[inside]] = place[inside]
            todo, at, level = todo[~hit], at[~hit] - 1, level[~hit]
            up = (at >= 0) & (at % 2 == 1)  # the last of its parent's two: the whole parent lies ahead
            at, level = np.where(up, at >> 1, at), level + up
            on = (at >= 0) & (((at + 1) << level) - 1 >= low[todo])
            todo, at, level = todo[on], at[on], level[on]
        return out

    def _descended(self, level: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place with enough inside each block, which has one."""
        level, at = level.copy(), at.copy()
        while (level > 0).any():
            for k in np.unique(level[level > 0]):
                here = level == k
                right = 2 * at[here] + 1
                at[here] = np.where(self.levels[k - 1][right] >= least[here], right, right - 1)
                level[here] = k - 1
        return at

    @classmethod
    def first(cls, values: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first such place: the last one from the other end."""
        top = len(values) - 1
        got = cls(values[::-1]).last(top - np.minimum(high, top), top - low, least)
        return np.where(got < 0, -1, top - got)


def matches(r: Rows, n_starts: int, gap: int, goal: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """First and last place, sum of cents and label digest of the matches that start at the first ``n_starts`` rows.

    All segments of these rows must be whole; the first row opens one.
    """
    label, near = labels(r, gap)
    place = np.arange(len(r))
    opens = np.flatnonzero(label == 0)
    segment = np.cumsum(label == 0) - 1
    rise = label == _UP
    last_rise = np.maximum.reduceat(np.where(rise, place, -1), opens)
    start = np.flatnonzero((label[1:] == _DOWN) & (r.code[:-1] >= 4))
    start = start[start < n_starts]
    end = last_rise[segment[start]]
    start, end = start[end > start], end[end > start]
    # Goal rows: a near click with a value, right after a row up.
    is_goal = near & (r.code == 6)
    is_goal[1:] &= rise[:-1]
    value = np.where(is_goal, r.cents, _NONE)
    if goal == "optional":
        low = high = end + 1  # the longest run has it right behind it or not at all
    else:
        next_rise = np.minimum.accumulate(np.where(rise, place, len(r))[::-1])[::-1]
        low, high = next_rise[start] + 1, end + 1
    if not len(start):
        p = start
    elif goal == "first":
        p = MaxTree.first(value, low, high, r.cents[start])
    else:
        p = MaxTree(value).last(low, high, r.cents[start])
    if goal != "optional":
        start, end, p = start[p >= 0], end[p >= 0], p[p >= 0]
    stop = np.where(p >= 0, p, end)
    upto = np.concatenate([[0], np.cumsum(np.where(r.code >= 4, r.cents, 0))])
    text = _LETTERS[label].tobytes()
    sha = [hashlib.sha256(b"A" + (text[s + 1 : e] + b"P" if q >= 0 else text[s + 1 : e + 1])).hexdigest() for s, e, q in zip(start.tolist(), stop.tolist(), p.tolist())]
    return start, stop, upto[stop + 1] - upto[start], sha


def attached(a: Rows, b: Rows | None, b_closed: bool, gap: int) -> tuple[Rows, bool]:
    """An open piece with the one that follows it, and whether its segment is whole now. No following piece ends it."""
    if b is None:
        return a, True
    if not len(b):
        return a, b_closed
    if not len(a):
        return b, b_closed
    if labels(a[-1:] + b[:1], gap)[0][1]:
        return a + b, b_closed
    return (a + b[:1] if b.client[0] == a.client[-1] else a), True


_MATCH = ("client_id", "part", "nth", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256")
#: What a task puts out: matches, and pieces of segments that go on elsewhere.
_TASK = pa.schema(
    [*((c, pa.int64()) for c in _MATCH[:-1]), (_MATCH[-1], pa.string()), ("kind", pa.string()), ("closed", pa.bool_()), ("n_before", pa.int64()), ("n_tail", pa.int64()), ("rows", pa.binary())]
)
_TASK_SQL = ", ".join(f"{c} long" for c in _MATCH[:-1]) + f", {_MATCH[-1]} string, kind string, closed boolean, n_before long, n_tail long, rows binary"


def _match_batch(r: Rows, part: int, first_nth: np.ndarray, found: tuple) -> pa.RecordBatch:
    start, stop, cents, sha = found
    n = len(start)
    own = [r.client[start], np.full(n, part), first_nth, r.ident[start], r.ident[stop], stop - start + 1, cents]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in own), pa.array(sha, pa.string()), *(pa.nulls(n, t.type) for t in list(_TASK)[len(_MATCH) :])], schema=_TASK)


def _piece_batch(part: int, kind: str, closed: bool, n_before: int, n_tail: int, rows: Rows) -> pa.RecordBatch:
    row = {"part": part, "kind": kind, "closed": closed, "n_before": n_before, "n_tail": n_tail, "rows": rows.packed()}
    return pa.RecordBatch.from_pylist([row], schema=_TASK)


def _ranks(client: np.ndarray, last: int | None, n: int) -> np.ndarray:
    """Numbers from 1 within each stretch of equal clients, going on from the n of the last one."""
    if not len(client):
        return client
    new = np.concatenate([[client[0] != last], client[1:] != client[:-1]])
    at = np.arange(len(client))
    since = np.maximum.accumulate(np.where(new, at, 0))
    rank = at - since + 1
    return np.where(np.cumsum(new) == 0, rank + n, rank)


def match_rows(clicks: DataFrame, goal: str = "optional", gap_minutes: int = GAP_MINUTES, fan: int = 256) -> DataFrame:
    """Per match: client_id, match_no, first_id, last_id, n_rows, sum_cents, labels_sha256.

    Distinct rows of ``clicks`` (whole rows, extra columns and all) count;
    those without client_id or ts don't. Rows are in order of ts and click_id;
    rows that tie, in order of kind, value and a hash of the whole row, nulls
    first. A null click_id comes before others and is reported as null. A value that is null, not a number or beyond 9e16 fits no letter,
    and what it stands between doesn't belong together. A null kind fits A only.
    An empty table gives an empty one.
    """
    if goal not in GOALS:
        raise ValueError(f"goal must be one of {GOALS}")
    with scratch() as keep:
        return keep(stored(_matched(clicks, goal, gap_minutes * 60_000_000, fan), "matches"))


def _matched(clicks: DataFrame, goal: str, gap: int, fan: int) -> DataFrame:
    some = clicks.filter("client_id is not null and ts is not null").distinct()
    valued = F.col("value").between(-LARGEST_VALUE, LARGEST_VALUE)
    code = F.when(F.col("kind") == "click", 2).when(F.col("kind").isNotNull() & (F.col("kind") != "error"), 1).otherwise(0) + F.when(valued, 4).otherwise(0)
    order = ["client_id", "ts", "click_id", "kind", "value", "tie"]
    rows = some.select(
        F.col("client_id").cast("long").alias("client_id"), "ts", F.col("click_id").cast("long").alias("click_id"), "kind", "value", F.xxhash64(*[f"`{c}`" for c in clicks.columns]).alias("tie"),
        F.when(valued, F.floor(F.lit(100) * F.col("value").cast("double") + F.lit(0.5)).cast("long")).otherwise(0).alias("cents"), code.cast("long").alias("code"),
    )
    dealt = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order[:3]]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    narrow = dealt.select("client_id", "ts", F.coalesce("click_id", F.lit(_NONE)).alias("click_id"), "cents", "code")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, head, closed = TaskContext.get().partitionId(), Rows.unpacked(None), None, False
        client, n = None, 0
        for b in batches:
            held = held + Rows.of(b)
            opens = np.flatnonzero(labels(held, gap)[0] == 0)
            if len(opens) < 2:  # still one segment
                continue
            if head is None:  # up to the first row that is sure to open another segment
                head, closed = held[: opens[1] + 1], True
                if head.client[-1] != head.client[0]:
                    head = head[:-1]
            whole = int(opens[-1])
            found = matches(held[: whole + 1], whole, gap, goal)
            if len(found[0]):
                own = held.client[found[0]]
                nth = _ranks(own, client, n)
                yield _match_batch(held, part, nth, found)
                client, n = own[-1], int(nth[-1])
            held = held[whole:]
        yield _piece_batch(part, "head", closed, 0, 0, held if head is None else head)
        if len(held):
            yield _piece_batch(part, "tail", False, n if client == held.client[0] else 0, len(held), held)

    done = stored(narrow.mapInArrow(search, _TASK_SQL), "tasks")
    heads = done.filter("kind = 'head'").select("part", "closed", "rows")
    tails = done.filter("kind = 'tail'").select("part", "n_before", "n_tail", "rows")
    whole, span = [], 1
    while True:
        reached = stored(_meeting(tails, heads, span, gap, ["n_before", "n_tail"]), "tails")
        whole.append(reached.filter("closed"))
        tails = reached.filter("not closed").drop("closed")
        if tails.isEmpty():
            break
        grown = _meeting(heads.filter("not closed").drop("closed"), heads, span, gap, [])
        heads = stored(heads.filter("closed").select(*grown.columns).unionByName(grown), "heads")
        span *= 2

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                r = Rows.unpacked(x["rows"])
                found = matches(r, x["n_tail"], gap, goal)
                yield _match_batch(r, x["part"], x["n_before"] + 1 + np.arange(len(found[0])), found)

    rest = reduce(DataFrame.unionByName, whole).select("part", "n_before", "n_tail", "rows").mapInArrow(finish, _TASK_SQL)
    every = stored(done.filter("kind is null").select(*_MATCH).unionByName(rest.select(*_MATCH)), "parts")
    counts = stored(every.groupBy("client_id", "part").agg(F.count("*").alias("n")), "counts")
    ahead = before(counts, ["client_id"], fan=fan).select("client_id", "part", "before")
    ident = lambda c: F.when(F.col(c) != F.lit(_NONE), F.col(c)).alias(c)
    out = joined_to(every, ahead, ["client_id", "part"])
    return out.select("client_id", (F.col("nth") + F.col("before")).alias("match_no"), ident("first_id"), ident("last_id"), "n_rows", "sum_cents", "labels_sha256")


def _meeting(pieces: DataFrame, heads: DataFrame, span: int, gap: int, own: list[str]) -> DataFrame:
    """Open pieces (part, own columns, rows), each with the head ``span`` tasks on, and whether it is closed now."""
    then = heads.select((F.col("part") - span).alias("_part"), F.col("closed").alias("_closed"), F.col("rows").alias("_rows"))
    schema = ", ".join(["part long", *[f"{c} long" for c in own], "closed boolean", "rows binary"])
    target = pa.schema([*((c, pa.int64()) for c in ("part", *own)), ("closed", pa.bool_()), ("rows", pa.binary())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                after = None if x["_closed"] is None else Rows.unpacked(x["_rows"])
                rows, closed = attached(Rows.unpacked(x["rows"]), after, bool(x["_closed"]), gap)
                yield pa.RecordBatch.from_pylist([{"part": x["part"], **{c: x[c] for c in own}, "closed": closed, "rows": rows.packed()}], schema=target)

    return pieces.join(then.hint("merge"), F.col("part") == F.col("_part"), "left").select("part", *own, "rows", "_closed", "_rows").mapInArrow(meet, schema)
