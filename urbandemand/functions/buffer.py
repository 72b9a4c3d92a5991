"""Areas around lines: what lies within a distance of any point of them, as valid rings.

Each segment has a round-ended outline of its own, which is convex. The area is
their union: of every edge the stretches that lie inside another outline are
cut out, and what is left is strung together to rings, outer ones against the
clock's sense and holes with it. Round ends have their corners at directions that are the
same for all, so outlines that meet in a bend share edges there, of which one
is kept. All shapes of a batch are cut at once; edges whose boxes don't meet
another outline's aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Corners of a full circle, and of an outline.
ROUND = 32
_HALF = ROUND // 2 + 2
CORNERS = 2 * _HALF
METRES_PER_DEGREE = 6371008.8 * math.pi / 180
#: Pairs of outlines that are cut at a time, and stretches too short to count, by an edge's length.
_PAIRS = 200
_SHORT = 1e-9
#: Further tries of a shape that rounding has broken.
TRIES = 6
_CIRCLE = np.stack([np.cos(np.arange(ROUND) * 2 * math.pi / ROUND), np.sin(np.arange(ROUND) * 2 * math.pi / ROUND)], 1)


def _round_end(at: np.ndarray, radius: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Half circles from a direction on, as corners."""
    step = 2 * math.pi / ROUND
    first = np.floor(start / step).astype(np.int64) + 1
    k = first[:, None] + np.arange(ROUND // 2)
    inner = _CIRCLE[k % ROUND]
    ends = [np.stack([np.cos(a), np.sin(a)], 1)[:, None] for a in (start, start + math.pi)]
    inner = np.where((k * step >= start[:, None] + math.pi - 1e-9)[..., None], ends[1], inner)  # as many corners for all
    return at[:, None] + radius[:, None, None] * np.concatenate([ends[0], inner, ends[1]], 1)


def outlines(p: np.ndarray, q: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Corners of the outlines of segments, against the clock's sense; a segment of no length has a circle."""
    turn = np.arctan2(q[:, 1] - p[:, 1], q[:, 0] - p[:, 0])
    return np.concatenate([_round_end(q, radius, turn - math.pi / 2), _round_end(p, radius, turn + math.pi / 2)], 1)


def _meeting(low: np.ndarray, high: np.ndarray, shape: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of outlines of one shape whose boxes meet, some at a time. Outlines of a shape stand together."""
    first = np.searchsorted(shape, shape, "left")
    size = np.searchsorted(shape, shape, "right") - first
    at = 0
    while at < len(shape):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 2000 * _PAIRS, "right")) + at)
        i = np.repeat(np.arange(at, upto), size[at:upto])
        j = np.arange(len(i)) + np.repeat(first[at:upto] + size[at:upto] - np.cumsum(size[at:upto]), size[at:upto])
        meet = (i != j) & (low[i] <= high[j]).all(1) & (low[j] <= high[i]).all(1)
        i, j = i[meet], j[meet]
        for k in range(0, len(i), _PAIRS):
            yield i[k : k + _PAIRS], j[k : k + _PAIRS]
        at = upto


def _near(low: np.ndarray, high: np.ndarray, start: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of outlines i, by their number among all edges, and the outlines j whose boxes they meet."""
    end = np.roll(start[i], -1, axis=1)
    meet = (np.minimum(start[i], end) <= high[j][:, None]).all(2) & (np.maximum(start[i], end) >= low[j][:, None]).all(2) & (length[i] > 0)
    pair, corner = np.nonzero(meet)
    return i[pair] * CORNERS + corner, j[pair]


def _inside(start: np.ndarray, step: np.ndarray, length: np.ndarray, edge: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where (0 to 1) each edge lies inside outline j; nowhere where the first isn't smaller.

    Outlines are the last axis of ``start``, ``step`` and ``length``; edges of no length have no step.
    """
    own, corner = edge // CORNERS, edge % CORNERS
    e = step[:, :, j]
    ahead = e[0] * (start[1, corner, own] - start[1][:, j]) - e[1] * (start[0, corner, own] - start[0][:, j])
    speed = e[0] * step[1, corner, own] - e[1] * step[0, corner, own]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = -ahead / speed
    enter = np.where(speed > 0, t, -np.inf).max(0)
    leave = np.where(speed < 0, t, np.inf).min(0)
    # Along an edge of the other: of two that share it the later outline's is cut out.
    along, n = np.nonzero(speed == 0)
    real, side = length[along, j[n]] > 0, ahead[along, n]
    leave[n[real & ((side < 0) | (side == 0) & (j[n] >= own[n]))]] = -np.inf
    return np.maximum(enter, 0.0), np.minimum(leave, 1.0)


def _left(edges: int, of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stretches from a to b of the edges ``of`` leave of all edges from 0 to 1."""
    of, a, b = (np.concatenate(x) for x in ((of, np.arange(edges), np.arange(edges)), (a, np.zeros(edges), np.ones(edges)), (b, np.zeros(edges), np.ones(edges))))
    order = np.lexsort((a, of))
    of, a, b = of[order], a[order], b[order]
    reach = np.maximum.accumulate(of * 2 + b) - of * 2  # as far as any stretch of the edge has come
    here = of[1:] == of[:-1]
    gap = here & (a[1:] - reach[:-1] > _SHORT)
    return of[1:][gap], reach[:-1][gap], a[1:][gap]


def _strung(p: np.ndarray, q: np.ndarray, grain: float) -> tuple[list[np.ndarray], bool]:
    """Rings of directed pieces that meet end to start, and whether some meet nothing."""
    cell = lambda x: tuple(np.floor(x / grain + 0.5).astype(np.int64).tolist())
    starts: dict[tuple, list[int]] = {}
    for k, x in enumerate(p):
        starts.setdefault(cell(x), []).append(k)
    used = np.zeros(len(p), bool)

    def follower(end: np.ndarray) -> int | None:
        x, y = cell(end)
        near = [k for i in (0, -1, 1) for j in (0, -1, 1) for k in starts.get((x + i, y + j), ()) if not used[k]]
        return min(near, key=lambda k: abs(p[k] - end).sum(), default=None)

    rings, loose = [], False
    for k in range(len(p)):
        if used[k]:
            continue
        ring = [k]
        used[k] = True
        while abs(q[ring[-1]] - p[k]).max() > grain and (n := follower(q[ring[-1]])) is not None:
            used[n] = True
            ring.append(n)
        if abs(q[ring[-1]] - p[k]).max() > grain:
            loose = True
        elif len(ring) > 2:
            rings.append(np.concatenate([p[ring], p[k : k + 1]]))
    return rings, loose


#: A direction in which corners hardly ever lie abreast.
_ASKEW = np.array([math.cos(0.7390851), math.sin(0.7390851)])


def _strung_at_once(p: np.ndarray, q: np.ndarray, bounds: np.ndarray, grain: np.ndarray) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """The rings of all shapes whose pieces have one follower each, as ``_strung`` makes them, and which shapes those are.

    ``bounds`` are where each shape's pieces begin. Ends and starts are sorted
    along one direction; where they agree one by one and no two starts are near
    each other in it, nothing else can follow.
    """
    shape = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    away, wide = p @ _ASKEW, grain[shape]
    start, end = np.lexsort((away, shape)), np.lexsort((q @ _ASKEW, shape))
    odd = abs(q[end] - p[start]).max(1, initial=0) > wide
    odd[1:] |= (shape[1:] == shape[:-1]) & (np.diff(away[start]) <= 6 * wide[1:])
    plain = np.bincount(shape[odd], minlength=len(bounds) - 1) == 0
    follower = np.arange(len(p))
    follower[end] = np.where(plain[shape], start, end)
    # The first piece of each ring, over leaps of 1, 2, 4, ... pieces.
    first, leap = np.arange(len(p)), follower
    for _ in range(int(np.diff(bounds).max(initial=1)).bit_length()):
        first, leap = np.minimum(first, first[leap]), leap[leap]
    heads = np.flatnonzero((first == np.arange(len(p))) & plain[shape])
    place, at, here = np.zeros(len(p), np.int64), heads, 0
    while len(at):
        place[at] = here
        at = follower[at]
        at, here = at[at != first[at]], here + 1
    order = np.lexsort((place, first))
    order = order[plain[shape[order]]]
    rings: list[list[np.ndarray]] = [[] for _ in plain]
    size = np.bincount(first, minlength=len(p))[heads]
    upto = np.cumsum(size)
    points = p[np.insert(order, upto, heads)]  # each ring's first point once more at its end
    for k, b, n in zip(shape[heads].tolist(), (upto + np.arange(1, len(heads) + 1)).tolist(), size.tolist()):
        if n > 2:
            rings[k].append(points[b - n - 1 : b])
    return rings, plain


def area(ring: np.ndarray) -> float:
    """Area inside a closed ring; below 0 in the clock's sense."""
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _holds(ring: np.ndarray, point: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    cross = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    a, b = a[cross], b[cross]
    return bool((point[0] < (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).sum() % 2)


def around(shapes: list[list[np.ndarray]], radius: np.ndarray, again: int = TRIES) -> list[list[list[np.ndarray]]]:
    """For each shape of lines the polygons around it: an outer ring and its holes.

    Where outlines touch so that rounding leaves no closed ring, the shape is
    done again with a radius that is larger by some millionths.
    """
    lines = [(k, line) for k, shape in enumerate(shapes) for line in shape if len(line)]
    out: list[list[list[np.ndarray]]] = [[] for _ in shapes]
    if not lines:
        return out
    point, line = np.concatenate([x for _, x in lines]), np.repeat(np.arange(len(lines)), [len(x) for _, x in lines])
    moved = np.append(True, (line[1:] != line[:-1]) | (np.diff(point, axis=0) != 0).any(1))
    point, line = point[moved], line[moved]
    lone = np.bincount(line)[line] == 1
    first = np.flatnonzero(np.append(line[1:] == line[:-1], False) | lone)
    p, q, of = point[first], point[first + ~lone[first]], np.array([k for k, _ in lines])[line[first]]
    ends = np.column_stack([of, np.where((q < p)[:, :1] | (q == p)[:, :1] & (q < p)[:, 1:], np.column_stack([q, p]), np.column_stack([p, q]))])
    kept = np.sort(np.unique(ends, axis=0, return_index=True)[1])  # a segment that a line goes twice counts once
    p, q, of = p[kept], q[kept], of[kept]
    corner = outlines(p, q, radius[of])
    step = np.roll(corner, -1, axis=1) - corner
    length = np.abs(step).max(2)
    tiny = length < 1e-9 * radius[of][:, None]
    step[tiny], length[tiny] = 0, 0
    found = []
    low, high = corner.min(1), corner.max(1)
    turned, turned_step, turned_length = (np.ascontiguousarray(x.T) for x in (corner, step, length))
    for i, j in _meeting(low, high, of):
        edge, other = _near(low, high, corner, length, i, j)
        a, b = _inside(turned, turned_step, turned_length, edge, other)
        found.append((edge[a < b], a[a < b], b[a < b]))
    edge, a, b = _left(len(p) * CORNERS, *(np.concatenate([x[k] for x in found]) if found else np.zeros(0, (np.int64, float, float)[k]) for k in range(3)))
    real = length.ravel()[edge] > 0
    edge, a, b = edge[real], a[real], b[real]
    flat, move = corner.reshape(-1, 2), step.reshape(-1, 2)
    left, right = flat[edge] + move[edge] * a[:, None], flat[edge] + move[edge] * b[:, None]
    shape = of[edge // CORNERS]
    bounds = np.searchsorted(shape, np.arange(len(shapes) + 1))
    strung, plain = _strung_at_once(left, right, bounds, 1e-6 * np.asarray(radius, float))
    for k in range(len(shapes)):
        own = slice(bounds[k], bounds[k + 1])
        rings, loose = (strung[k], False) if plain[k] else _strung(left[own], right[own], 1e-6 * float(radius[k]))
        if len(rings) == 1 and not loose:  # it is the outer one
            out[k] = [rings] if area(rings[0]) > 0 else []
            continue
        if loose and again:
            out[k] = around([shapes[k]], radius[k : k + 1] * (1 + 1.7e-6), again - 1)[0]
            continue
        outer = [r for r in rings if area(r) > 0]
        polygons = [[r] for r in outer]
        for hole in (r for r in rings if area(r) < 0):
            inside = [n for n, r in enumerate(outer) if _holds(r, hole[0])]
            if inside:
                polygons[min(inside, key=lambda n: area(outer[n]))].append(hole)
        out[k] = polygons
    return out


_POLYGONS = ArrayType(ArrayType(ArrayType(ArrayType(DoubleType()))))
_ARROW = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


def _points(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All points of lists of lines, how many points each line has, and how many lines each row."""
    n_lines = pc.fill_null(pc.list_value_length(lines), 0).to_numpy()
    each = lines.flatten()
    n_points = pc.fill_null(pc.list_value_length(each), 0).to_numpy()
    point = each.flatten()
    size = pc.fill_null(pc.list_value_length(point), 0).to_numpy()
    values = np.append(pc.fill_null(point.flatten(), np.nan).to_numpy(zero_copy_only=False), [np.nan, np.nan])
    at = np.cumsum(size) - size
    return np.stack([np.where(size > k, values[np.minimum(at + k, len(values) - 1)], np.nan) for k in (0, 1)], 1), n_points, n_lines


def _buffered(lines: pa.Array, radius: pa.Array, metres: bool) -> pa.Array:
    """Polygons around each row's lines; null where lines or radius are, none where they hold no point or the radius isn't above 0."""
    points, n_points, n_lines = _points(lines)
    r = pc.fill_null(radius, np.nan).to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.repeat(np.arange(len(lines)), n_lines), n_points)
    lat = np.bincount(row, points[:, 1], minlength=len(lines)) / np.maximum(np.bincount(row, minlength=len(lines)), 1)
    scale = np.stack([METRES_PER_DEGREE * np.cos(np.radians(lat)), np.full(len(lines), METRES_PER_DEGREE)], 1) if metres else np.ones((len(lines), 2))
    each = np.split(points * scale[row], np.cumsum(n_points)[:-1]) if len(n_points) else []
    first = np.cumsum(n_lines) - n_lines
    odd = np.bincount(np.repeat(np.arange(len(n_points)), n_points), ~np.isfinite(points).all(1), len(n_points)) > 0
    shapes = [[x for x, o in zip(each[f : f + n], odd[f : f + n]) if not o] if r[k] > 0 else [] for k, (f, n) in enumerate(zip(first, n_lines))]
    known = (pc.is_valid(lines).to_numpy(zero_copy_only=False)) & ~np.isnan(r)
    found = around(shapes, np.where(r > 0, r, 1.0))
    polygons = [p for row in found for p in row]
    rings = [ring for p in polygons for ring in p]
    starts = lambda sizes: np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int32)
    sizes = [len(ring) for ring in rings]
    row_of = np.repeat(np.arange(len(found)), [sum(len(ring) for p in row for ring in p) for row in found])
    flat = (np.concatenate(rings) if rings else np.zeros((0, 2))) / scale[row_of]
    pairs = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * 2, pa.array(flat.ravel()))
    deep = pa.ListArray.from_arrays(starts([len(p) for p in polygons]), pa.ListArray.from_arrays(starts(sizes), pairs))
    return pa.ListArray.from_arrays(pa.array(starts([len(row) for row in found])), deep, mask=pa.array(~known))


@F.arrow_udf(_POLYGONS)
def _metres(lines: pa.Array, radius: pa.Array) -> pa.Array:
    return _buffered(lines, radius, True)


@F.arrow_udf(_POLYGONS)
def _degrees(lines: pa.Array, radius: pa.Array) -> pa.Array:
    return _buffered(lines, radius, False)


def buffer_metres(lines: Column, radius: Column) -> Column:
    """Polygons (rings of lon-lat pairs, the outer one first) within a distance in metres of lines, in the plane at their mean latitude."""
    return _metres(lines, radius)


def buffer_degrees(lines: Column, radius: Column) -> Column:
    """Polygons within a distance in degrees of lines."""
    return _degrees(lines, radius)
