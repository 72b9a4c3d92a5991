"""Drawings of polygons."""

from __future__ import annotations

import math


def svg_path(rings: list, size: int, west: float, north: float, scale: float) -> str:
    """A path of rings given in web-map metres."""
    draw = lambda ring: "M" + " ".join(f"{round((x - west) * scale, 2):g},{round((north - y) * scale, 2):g}" for x, y in ring)
    return f'<path d="{" ".join(draw(r) for r in rings)}"/>'


def svg(polygons: list[list], size: int = 800) -> str:
    """A square drawing of polygons in degrees, fitted to its height."""
    half = 20037508.3427892
    to = lambda p: (p[0] * half / 180, math.log(math.tan((90 + p[1]) * math.pi / 360)) * half / math.pi)
    flat = [[[to(p) for p in ring] for ring in polygon] for polygon in polygons]
    points = [p for polygon in flat for ring in polygon for p in ring]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}" viewBox="0 0 {size} {size}">'
    if not points:
        return head + "</svg>"
    west, south, north = min(x for x, _ in points), min(y for _, y in points), max(y for _, y in points)
    scale = size / max(north - south, 1e-9)
    return head + '<g id="water" fill="#9FC9EA">' + "".join(svg_path(p, size, west, north, scale) for p in flat) + "</g></svg>"
