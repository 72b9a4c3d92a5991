"""Tiles in order of a Hilbert curve: numbers, and boxes as stretches of the curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert(x: Column, y: Column, bits: int) -> Column:
    """A cell's place on the curve over 2**bits by 2**bits cells."""

    def step(acc: Column, side: Column) -> Column:
        rx, ry = (acc["x"].bitwiseAND(side) > 0).cast("long"), (acc["y"].bitwiseAND(side) > 0).cast("long")
        d = acc["d"] + side * side * (rx * 3).bitwiseXOR(ry)
        # The quarter's own curve is turned: swapped, and mirrored where it runs back.
        mirrored = (ry == 0) & (rx == 1)
        mx, my = F.when(mirrored, side - 1 - acc["x"].bitwiseAND(side - 1)).otherwise(acc["x"].bitwiseAND(side - 1)), F.when(mirrored, side - 1 - acc["y"].bitwiseAND(side - 1)).otherwise(acc["y"].bitwiseAND(side - 1))
        return F.struct(F.when(ry == 0, my).otherwise(mx).alias("x"), F.when(ry == 0, mx).otherwise(my).alias("y"), d.alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    sides = [F.lit(1 << k).cast("long") for k in reversed(range(bits))]
    return F.aggregate(F.array(*sides), start, step, lambda acc: acc["d"]) if bits else F.lit(0).cast("long")


def first_of_zoom(z: int) -> int:
    """Tiles of all smaller zooms together."""
    return (4**z - 1) // 3


def tile_number(z: Column, x: Column, y: Column, largest: int = 26) -> Column:
    """A tile's number: smaller zooms come first, and the curve within each."""
    out = F.lit(None).cast("long")
    for k in range(largest + 1):
        out = F.when(z == k, F.lit(first_of_zoom(k)) + hilbert(x, y, k)).otherwise(out)
    return out


def place_of(z: int, x: int, y: int) -> int:
    """``tile_number`` of one tile."""
    d, side = 0, 1 << z
    while side > 1:
        side >>= 1
        rx, ry = int(x & side > 0), int(y & side > 0)
        d += side * side * ((3 * rx) ^ ry)
        x, y = x & (side - 1), y & (side - 1)
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return first_of_zoom(z) + d


def tile_at(number: int) -> tuple[int, int, int]:
    """z, x and y of a tile's number."""
    z = 0
    while first_of_zoom(z + 1) <= number:
        z += 1
    d, x, y, side = number - first_of_zoom(z), 0, 0, 1
    while side < 1 << z:
        rx = 1 & (d >> 1)
        ry = 1 & (d ^ rx)
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y, d, side = x + side * rx, y + side * ry, d >> 2, side << 1
    return z, x, y


def stretches(z: int, x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """The numbers of a box's tiles (ends included) as few stretches from a first to a last, in order.

    A quarter that lies inside the box is one stretch, and only quarters at
    its edge are divided, so there are as many as the box's edge is long at most.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, 0, z)]
    while todo:
        x, y, k = todo.pop()
        side = 1 << k
        if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
            continue
        if x0 <= x and x + side - 1 <= x1 and y0 <= y and y + side - 1 <= y1:
            at = place_of(z - k, x >> k, y >> k) - first_of_zoom(z - k)
            out.append((first_of_zoom(z) + (at << 2 * k), first_of_zoom(z) + (at + 1 << 2 * k) - 1))
            continue
        half = side >> 1
        todo += [(x + i * half, y + j * half, k - 1) for i in (0, 1) for j in (0, 1)]
    out.sort()
    joined: list[tuple[int, int]] = []
    for first, last in out:
        if joined and joined[-1][1] + 1 == first:
            joined[-1] = (joined[-1][0], last)
        else:
            joined.append((first, last))
    return joined
