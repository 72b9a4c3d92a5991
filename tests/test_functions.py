import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbandemand.functions import buffer, geo, num, shapes, text
from urbandemand.sources.tiles import decode_tile, decoded

SQUARE = "array(named_struct('lat',43.6D,'lon',-79.4D),named_struct('lat',43.6D,'lon',-79.399D),named_struct('lat',43.601D,'lon',-79.399D),named_struct('lat',43.601D,'lon',-79.4D),named_struct('lat',43.6D,'lon',-79.4D))"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def _rings_made(spark, capsys, f):
    """How often the plan of a function of a ring makes the ring."""
    ring = F.filter(F.expr(SQUARE), lambda p: p["lon"] != 123.4375)
    spark.range(1).select(f(ring).alias("x")).explain()
    return capsys.readouterr().out.count("123.4375")


def test_area_makes_its_ring_once(spark, capsys):
    assert _rings_made(spark, capsys, geo.ring_area) == 1


def test_centroid_makes_its_ring_once(spark, capsys):
    assert _rings_made(spark, capsys, geo.centroid) == 1


def test_ring_area(spark):
    assert one(spark, geo.ring_area(F.expr(SQUARE))) == pytest.approx(8953.836952948832, rel=1e-9)
    assert one(spark, geo.box_area(F.lit(-79.4), F.lit(43.6), F.lit(-79.399), F.lit(43.601))) == pytest.approx(8953.836952948832, rel=1e-9)


def test_ring_closing(spark):
    open_ring = F.slice(F.expr(SQUARE), 1, 4)
    assert one(spark, F.size(geo.closed(open_ring))) == 5
    assert one(spark, F.size(geo.closed(F.expr(SQUARE)))) == 5


def test_centroid(spark):
    c = one(spark, geo.centroid(F.expr(SQUARE)))
    assert (c.lon, c.lat) == (pytest.approx(-79.3995), pytest.approx(43.6005))
    flat = F.expr("array(named_struct('lat',1D,'lon',1D),named_struct('lat',2D,'lon',2D),named_struct('lat',3D,'lon',3D),named_struct('lat',1D,'lon',1D))")
    assert one(spark, geo.centroid(flat)).lon == pytest.approx(2)


def test_haversine(spark):
    m = one(spark, geo.haversine(F.lit(-79.40), F.lit(43.60), F.lit(-79.38), F.lit(43.65)))
    assert round(m) == 5788 and round(m * 0.12) == 695
    assert one(spark, geo.haversine(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0


@pytest.mark.parametrize("x,want", [(2.5, 3), (-2.5, -2), (0.49, 0), (400.5, 401)])
def test_round_half_up(spark, x, want):
    assert one(spark, num.round_half_up(F.lit(x))) == want


@pytest.mark.parametrize("given,value,levels", [("12", 12.0, 12.0), (" 3.5\t", 3.5, 3.5), ("3;4", None, 1.0), ("", 0.0, 1.0), ("1d", None, 1.0), ("inf", None, 1.0), ("0x10", 16.0, 16.0), ("-2", -2.0, 1.0), (None, None, 1.0)])
def test_numbers(spark, given, value, levels):
    t = F.lit(given).cast("string")
    assert one(spark, num.number(t)) == value
    assert one(spark, num.at_least_one(t)) == levels


def test_ratio_by_nothing(spark):
    assert one(spark, num.ratio(F.lit(3), F.lit(0))) is None


@pytest.mark.parametrize("tags,want", [({"noname": "yes", "name": "A"}, ""), ({"name": "\t A "}, "A"), ({"ref": "401"}, "401"), ({"name:en": " ", "name": "B"}, "B"), ({"name:en": "C", "name": "B"}, "C"), ({}, "")])
def test_street_name(spark, tags, want):
    frame = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert frame.select(text.street_name(F.col("tags")).alias("v")).first().v == want


def test_slug(spark):
    assert one(spark, text.slug(F.lit("S-Train  Big"))) == "strain_big"
    assert one(spark, text.slug(F.lit(" S-Train Big "), dashes=True)) == "s_train_big"


def test_tiles(spark):
    assert [one(spark, geo.tile_x(F.lit(x), 12)) for x in (-79.671478, -79.232368)] == [1141, 1146]
    assert [one(spark, geo.tile_y(F.lit(y), 12)) for y in (43.788693, 43.571686)] == [1492, 1496]


def test_mercator_round_trip(spark):
    lat = one(spark, geo.unmercator_lat(geo.mercator_y(F.lit(43.6))))
    lon = one(spark, geo.unmercator_lon(geo.mercator_x(F.lit(-79.4))))
    assert (lon, lat) == (pytest.approx(-79.4), pytest.approx(43.6))


def test_cell_edges(spark):
    at = lambda x: one(spark, geo.cell(F.lit(x), F.lit(0.0), F.lit(0.1), F.lit(3)))
    assert [at(0.0), at(0.1), at(0.29), at(-0.01), at(0.31)] == [0, 1, 2, None, None]


def _tile():
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    field = lambda n, raw: varint(n << 3 | 2) + varint(len(raw)) + raw
    zig = lambda n: varint((n << 1) ^ (n >> 31))
    square = varint(9) + zig(0) + zig(0) + varint(3 << 3 | 2) + zig(4096) + zig(0) + zig(0) + zig(4096) + zig(-4096) + zig(0) + varint(15)
    line = varint(9) + zig(0) + zig(0) + varint(1 << 3 | 2) + zig(4096) + zig(4096)
    feature = lambda kind, g, tags: field(2, b"".join(map(varint, tags))) + varint(3 << 3) + varint(kind) + field(4, g)
    layer = field(1, b"water") + field(2, feature(3, square, [0, 0])) + field(2, feature(2, line, [0, 1, 1, 2])) + field(3, b"kind") + field(3, b"min_zoom")
    layer += field(4, field(1, b"ocean")) + field(4, field(1, b"stream")) + field(4, varint(4 << 3) + varint(7)) + varint(5 << 3) + varint(4096)
    return field(3, layer) + field(3, field(1, b"earth"))


def test_decode_tile(spark):
    a, b = decode_tile(gzip.compress(_tile()), "water", 1, 0, 0)
    assert a[0] == {"kind": "ocean"} and a[1] == "Polygon" and a[2][0][0] == a[2][0][-1] == [-180.0, pytest.approx(85.0511287798)]
    assert a[2][0][2] == [0.0, pytest.approx(0.0, abs=1e-9)]
    assert b[:2] == ({"kind": "stream", "min_zoom": "7"}, "LineString")
    rows = spark.createDataFrame([("c", 1, 0, 0, bytearray(_tile())), ("c", 1, 0, 1, bytearray()), ("c", 1, 1, 1, bytearray(b"\x1f\x8bjunk")), ("c", 1, 1, 0, None)], "city string, z int, x int, y int, payload binary")
    got = decoded(rows, "water").collect()
    assert [r.kind for r in got] == ["Polygon", "LineString"] and json.loads(got[0].coordinates) == a[2]
    assert struct.calcsize("<f") == 4


def test_drawing():
    assert "<path" in shapes.svg([[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]) and shapes.svg([]).endswith("</svg>")


def _distance(points, lines):
    out = np.full(len(points), np.inf)
    for line in lines:
        for a, b in zip(line[:-1], line[1:]) if len(line) > 1 else [(line[0], line[0])]:
            t = np.clip((points - a) @ (b - a) / max((b - a) @ (b - a), 1e-300), 0, 1)
            out = np.minimum(out, np.hypot(*(points - a - t[:, None] * (b - a)).T))
    return out


def _inside(points, polygons):
    n = np.zeros(len(points), int)
    for ring in (r for p in polygons for r in p):
        for a, b in zip(ring[:-1], ring[1:]):
            crossed = (a[1] > points[:, 1]) != (b[1] > points[:, 1])
            with np.errstate(all="ignore"):
                n += crossed & (points[:, 0] < (b[0] - a[0]) * (points[:, 1] - a[1]) / (b[1] - a[1]) + a[0])
    return n % 2 == 1


def _crossings(ring):
    a, d = ring[:-1], np.diff(ring, axis=0)
    k = np.arange(len(a))
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    with np.errstate(all="ignore"):
        gap, turn = a[None] - a[:, None], cross(d[:, None], d[None])
        t, u = cross(gap, d[None]) / turn, cross(gap, d[:, None]) / turn
    apart = (abs(k[:, None] - k) > 1) & (abs(k[:, None] - k) < len(k) - 1)
    return int((apart & (abs(turn) > 1e-14) & (t > 1e-6) & (t < 1 - 1e-6) & (u > 1e-6) & (u < 1 - 1e-6)).sum())


def test_buffers_are_valid_and_hold_what_is_near():
    """Bent, closed, crossing and doubled lines, and lines of several parts, against sampled distances."""
    rng = np.random.default_rng(4)
    drawn = []
    for k in range(80):
        n = rng.integers(1, 9)
        line = rng.integers(0, 8, (n, 2)).astype(float) if k % 2 else rng.uniform(0, 8, (n, 2))
        line = np.concatenate([line, line[:1]]) if k % 5 == 0 else np.concatenate([line, line[::-1]]) if k % 7 == 0 else line
        drawn.append([line, rng.uniform(0, 8, (3, 2))] if k % 3 == 0 else [line])
    turns = np.linspace(0, 2 * np.pi, 60)
    drawn.append([np.stack([np.cos(turns), np.sin(turns)], 1) * 4])
    radius = rng.uniform(0.2, 1.5, len(drawn))
    points = rng.uniform(-2, 10, (4000, 2))
    holes = 0
    for lines, r, polygons in zip(drawn, radius, buffer.around(drawn, radius)):
        away = _distance(points, lines)
        unsure = (away > 0.993 * r) & (away < 1.001 * r)  # round parts have straight edges
        assert ((_inside(points, polygons) == (away < r)) | unsure).all()
        assert sum(_crossings(ring) for p in polygons for ring in p) == 0
        assert all(buffer.area(p[0]) > 0 and all(buffer.area(h) < 0 for h in p[1:]) for p in polygons)
        holes += sum(len(p) - 1 for p in polygons)
    assert holes > 10


def test_buffer_of_a_bend():
    ((ring,),) = buffer.around([[np.array([[0.0, 0.0], [10.0, 0.0], [10.0, 10.0]])]], np.array([2.0]))[0]
    # 2 x 40 for the sides, less the inner corner's square, two half circles, and a quarter outside the bend.
    assert buffer.area(ring) == pytest.approx(80 - 4 + 5 * np.pi, rel=0.003)


def test_buffers_of_columns(spark):
    rows = spark.createDataFrame([(1, [[[0.0, 60.0], [0.001, 60.0]]], 10.0), (2, None, 10.0), (3, [[[0.0, 0.0]]], None), (4, [], 5.0), (5, [[[1.0, 1.0], [1.0, 1.0]]], 5.0), (6, [[[1.0, 1.0]]], -1.0)], "id int, lines array<array<array<double>>>, r double")
    got = {r.id: r.p for r in rows.select("id", buffer.buffer_metres("lines", F.col("r")).alias("p")).collect()}
    assert (got[2], got[3], got[4], got[6]) == (None, None, [], [])
    (outer,) = got[1][0]
    assert min(p[0] for p in outer) == pytest.approx(-10 / (111195.08 * 0.5), rel=1e-5) and max(p[1] for p in outer) == pytest.approx(60 + 10 / 111195.08, rel=1e-9)
    assert len(got[5]) == 1 and len(got[5][0][0]) > 16


def test_plain_buffers_are_strung_at_once(monkeypatch):
    """Rings of bends, loops with a hole and crossings take no walk from piece to piece."""
    lines = [[[0, 0], [9, 0], [9, 4], [0, 4]], [[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[1, 1], [8, 7]]]
    shapes = [[np.array(x, float)] for x in lines] + [[], [np.array([[0.0, 0.0], [9.0, 1.0]]), np.array([[50.0, 0.0], [50.5, 9.0]])]]
    radius = np.full(len(shapes), 1.1)
    strung = buffer._strung
    monkeypatch.setattr(buffer, "_strung_at_once", lambda p, q, bounds, grain: ([[]] * len(shapes), np.zeros(len(shapes), bool)))
    want = buffer.around(shapes, radius)
    monkeypatch.undo()
    monkeypatch.setattr(buffer, "_strung", lambda *_: pytest.fail("walked"))
    got = buffer.around(shapes, radius)
    assert [[len(p) for p in s] for s in got] == [[1], [2], [1], [], [1, 1]] and strung is not buffer._strung
    assert all((r == w).all() for s, t in zip(got, want) for p, q in zip(s, t) for r, w in zip(p, q))


def test_edges_far_from_an_outline_are_not_cut(monkeypatch):
    """Of a bend's two outlines only the edges about the corner are looked at, and the ring is what cutting all edges gives."""
    bend, seen, inside = [[np.array([[0.0, 0.0], [90.0, 0.0], [90.0, 90.0]])]], [], buffer._inside
    monkeypatch.setattr(buffer, "_inside", lambda *given: (cut := inside(*given), seen.append(cut[0].size))[0])
    ((ring,),) = buffer.around(bend, np.array([2.0]))[0]
    assert 2 < sum(seen) <= buffer.CORNERS + 8  # of 2 * CORNERS
    monkeypatch.setattr(buffer, "_near", lambda low, high, start, length, i, j: (np.repeat(i, buffer.CORNERS) * buffer.CORNERS + np.tile(np.arange(buffer.CORNERS), len(i)), np.repeat(j, buffer.CORNERS)))
    ((whole,),) = buffer.around(bend, np.array([2.0]))[0]
    assert (ring == whole).all()
