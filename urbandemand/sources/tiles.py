"""Vector tiles: ranges of a box and decoding of their layers."""

from __future__ import annotations

import gzip
import json
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import tile_x, tile_y
from ..lookups import WATER_KINDS
from .tile_source import fetched


def tile_range(places: DataFrame, zoom: int) -> DataFrame:
    """``city, z, x, y`` of every tile that a place's box touches."""
    b = F.col("bbox")
    out = places.select(F.col("code").alias("city"), tile_x(b[0], zoom).alias("x0"), tile_x(b[2], zoom).alias("x1"), tile_y(b[3], zoom).alias("y0"), tile_y(b[1], zoom).alias("y1"))
    out = out.filter("x1 >= x0 and y1 >= y0").select("city", "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("x"))
    return out.select("city", F.lit(zoom).alias("z"), "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def read_tiles(wanted: DataFrame, folder: str) -> DataFrame:
    """``wanted`` (city, z, x, y) with ``payload``, from files ``folder/city/z/x/y.mvt``; tiles that are missing are left out."""
    return fetched(wanted, folder)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _messages(raw: bytes) -> Iterator[tuple[int, object]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(raw, at)
        elif wire == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[wire]
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


def _packed(raw: bytes) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        value, at = _varint(raw, at)
        out.append(value)
    return out


def _signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _value(raw: bytes) -> str | None:
    for number, v in _messages(raw):
        if number == 1:
            return v.decode()
        if number == 2:
            return repr(struct.unpack("<f", v)[0])
        if number == 3:
            return repr(struct.unpack("<d", v)[0])
        if number in (4, 5):
            return str(v)
        if number == 6:
            return str(_signed(v))
        if number == 7:
            return "true" if v else "false"
    return None


def _lines(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Point lists of a geometry's drawing commands; a closed one ends where it began."""
    out: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        what, times = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == 7:
            out[-1].append(out[-1][0])
            continue
        for _ in range(times):
            x, y = x + _signed(commands[at]), y + _signed(commands[at + 1])
            at += 2
            if what == 1:
                out.append([])
            out[-1].append((x, y))
    return out


def _turn(ring: list[tuple[int, int]]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def decode_tile(raw: bytes, layer: str, z: int, x: int, y: int) -> list[tuple[dict, str, list]]:
    """Properties, geometry type and lon-lat coordinates of a layer's features."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    out = []
    for number, body in _messages(raw):
        if number != 3:
            continue
        fields = list(_messages(body))
        if next(v for n, v in fields if n == 1).decode() != layer:
            continue
        keys = [v.decode() for n, v in fields if n == 3]
        values = [_value(v) for n, v in fields if n == 4]
        extent = next((v for n, v in fields if n == 5), 4096)

        def place(p: tuple[int, int]) -> list[float]:
            lon = (p[0] / extent + x) * 360 / 2**z - 180
            lat = 360 / math.pi * math.atan(math.exp((180 - (p[1] / extent + y) * 360 / 2**z) * math.pi / 180)) - 90
            return [lon, lat]

        for f in (v for n, v in fields if n == 2):
            parts = dict(_messages(f))
            tags = _packed(parts.get(2, b""))
            lines = _lines(_packed(parts.get(4, b"")))
            kind = parts.get(3, 0)
            if kind == 1:
                points = [place(p) for line in lines for p in line]
                shape = ("Point", points[0]) if len(points) == 1 else ("MultiPoint", points)
            elif kind == 2:
                many = [[place(p) for p in line] for line in lines]
                shape = ("LineString", many[0]) if len(many) == 1 else ("MultiLineString", many)
            else:
                groups: list[list] = []
                outer = None
                for ring in lines:
                    turn = _turn(ring)
                    if not turn:
                        continue
                    outer = outer or (turn > 0)
                    if (turn > 0) == outer or not groups:
                        groups.append([])
                    groups[-1].append([place(p) for p in ring])
                shape = ("Polygon", groups[0]) if len(groups) == 1 else ("MultiPolygon", groups)
            out.append(({keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}, *shape))
    return out


def decoded(tiles: DataFrame, layer: str) -> DataFrame:
    """``city, z, x, y, kind, coordinates, properties`` of a layer's features.

    ``tiles`` has city, z, x, y and payload. A tile without the layer, an empty
    one and one that can't be read have no features.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for city, z, x, y, payload in b[["city", "z", "x", "y", "payload"]].itertuples(index=False):
                try:
                    found = decode_tile(bytes(payload), layer, z, x, y) if payload is not None and len(payload) else []
                except (IndexError, KeyError, StopIteration, struct.error, OSError, EOFError, UnicodeDecodeError):
                    found = []
                rows += [(city, z, x, y, kind, json.dumps(c), {k: v for k, v in p.items() if v is not None}) for p, kind, c in found]
            yield pd.DataFrame(rows, columns=["city", "z", "x", "y", "kind", "coordinates", "properties"])

    return tiles.mapInPandas(run, "city string, z int, x int, y int, kind string, coordinates string, properties map<string,string>")


def water_features(tiles: DataFrame) -> DataFrame:
    """Features of the water layer that are of a kind that counts."""
    return decoded(tiles, "water").filter(F.col("properties")["kind"].isin(*WATER_KINDS))
