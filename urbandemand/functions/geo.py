"""Geometry as column expressions. Points are structs of lat and lon in degrees."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth, and half the width of the web map, in metres.
RADIUS = 6371008.8
WEB_HALF = 20037508.3427892


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once: what a function over an array names besides its own arguments is made at every mention."""
    return F.transform(F.array(value), f)[0]


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two places along a great circle."""
    s = F.sin(F.radians(lat2 - lat1) / 2)
    t = F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + t * t * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.lit(2 * RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def closed(ring: Column) -> Column:
    """The ring with its first point repeated at the end."""
    return F.when(ring[0] != F.element_at(ring, -1), F.concat(ring, F.array(ring[0]))).otherwise(ring)


def ring_area(ring: Column) -> Column:
    """Square metres inside a closed ring on the sphere."""
    return bound(ring, _ring_area)


def _ring_area(ring: Column) -> Column:
    n = F.size(ring) - 1

    def add(acc: Column, i: Column) -> Column:
        low, mid, high = ring[i], ring[(i + 1) % n], ring[(i + 2) % n]
        return acc + (F.radians(high["lon"]) - F.radians(low["lon"])) * F.sin(F.radians(mid["lat"]))

    return F.when(n >= 3, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), add)) * F.lit(RADIUS * RADIUS / 2)).otherwise(F.lit(0.0))


def box_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Square metres of a box: the closed form of ``ring_area``."""
    return F.lit(RADIUS * RADIUS) * F.radians(east - west) * (F.sin(F.radians(north)) - F.sin(F.radians(south)))


def centroid(ring: Column) -> Column:
    """Area-weighted centre of a closed ring in the plane, as a struct.

    The mean of the corners where the ring has no area. Coordinates are taken
    from the first corner on, which keeps the sums small.
    """
    return bound(ring, _centroid)


def _centroid(ring: Column) -> Column:
    n = F.size(ring) - 1
    x0, y0 = ring[0]["lon"], ring[0]["lat"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, i: Column) -> Column:
        xi, yi, xj, yj = ring[i]["lon"] - x0, ring[i]["lat"] - y0, ring[i + 1]["lon"] - x0, ring[i + 1]["lat"] - y0
        cross = xi * yj - xj * yi
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (xi + xj) * cross).alias("x"), (acc["y"] + (yi + yj) * cross).alias("y"))

    mean = lambda field: F.aggregate(F.slice(ring, 1, n), F.lit(0.0), lambda acc, p: acc + p[field]) / n

    def centre(s: Column) -> Column:
        flat = s["a"] == 0
        lon = F.when(flat, mean("lon")).otherwise(x0 + F.try_divide(s["x"], s["a"] * 3))
        lat = F.when(flat, mean("lat")).otherwise(y0 + F.try_divide(s["y"], s["a"] * 3))
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    return bound(F.aggregate(F.sequence(F.lit(0), n - 1), zero, add), centre)


def box_of(points: Column) -> Column:
    """West, south, east and north of some points, as a struct."""
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def cell(x: Column, low: Column, size: Column, n: Column) -> Column:
    """Number of the half-open cell ``[low + i * size, low + (i + 1) * size)`` of ``n``; null outside.

    The quotient is set right by one where it disagrees with these bounds.
    """
    i = F.floor((x - low) / size)
    i = F.when(x < low + i * size, i - 1).when(x >= low + (i + 1) * size, i + 1).otherwise(i)
    return F.when((i >= 0) & (i < n), i.cast("int"))


def stretched(size: float, latitude: Column) -> Column:
    """A cell's width in degrees of longitude at a latitude."""
    return F.lit(size) * (F.lit(1.0) / F.cos(latitude * math.pi / 180))


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180) / 360 * float(2**zoom)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    phi = lat * math.pi / 180
    return F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * float(2**zoom)).cast("int")


def mercator_x(lon: Column) -> Column:
    return lon * (WEB_HALF / 180)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan((lat + 90) * (math.pi / 360))) * (WEB_HALF / math.pi)


def unmercator_lon(x: Column) -> Column:
    return x / WEB_HALF * 180.0


def unmercator_lat(y: Column) -> Column:
    return F.atan(F.exp(y / WEB_HALF * math.pi)) * 360.0 / math.pi - 90.0
