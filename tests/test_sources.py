"""Readers that split, skip and try again, and ordered documents."""

import gzip
import json
import os
import random
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from urbandemand.functions import curve
from urbandemand.operators import coverage, routing
from urbandemand.sinks import layers, publish
from urbandemand.sinks.ordered import write_features, write_ordered
from urbandemand.sources import osm, tiles
from urbandemand.sources.json_array import array_objects, read_array
from urbandemand.sources.tile_source import GZIP, HEAD, MAGIC, VERSION, TileArchive, TileFiles, file_bytes, tile_table, tiles_of

SIGNS = ["{", "}", "[", "]", '"', "\\", "\n", ",", "a", "é", "\U0001f600", '\\"', "}\\", "\\u007d"]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 601)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _objects(n):
    rng = random.Random(n)
    return [{"id": k, "s": "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 12))), "p": [{"x": j} for j in range(rng.randint(0, 3))], "n": {"a": {"b": "}"}}} for k in range(n)]


def test_array_is_read_by_many_tasks(spark, tmp_path, small_splits):
    objects = _objects(90)
    texts = {"one": json.dumps(objects, ensure_ascii=False), "lines": json.dumps(objects, indent=1) + "\n", "empty": "[]", "none": "", "cut": json.dumps(objects)[:2000]}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "one.json")).select("_metadata.file_block_start").distinct().count() > 10
    got = {}
    for r in array_objects(spark, [str(tmp_path / f"{n}.json") for n in texts]).collect():
        got.setdefault(os.path.basename(r["document"])[:-5], {})[r["ordinal"]] = json.loads(r["text"])
    assert got["one"] == got["lines"] == dict(enumerate(objects))
    assert got["cut"] == dict(enumerate(objects[: len(got["cut"])])) and 5 < len(got["cut"]) < 40
    assert set(got) == {"one", "lines", "cut"}


def test_array_as_the_plain_reader_has_it(spark, tmp_path, small_splits):
    elements = [{"type": "way", "id": k, "tags": {"name": f'a "{k}" }}'}, "geometry": [{"lat": k / 7, "lon": -k / 3}] * (k % 4)} for k in range(40)]
    (tmp_path / "e.json").write_text(json.dumps(elements))
    schema = "type string, id long, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"
    plain = spark.read.text(str(tmp_path / "e.json"), wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>")).alias("ordinal", "e"))
    want = [(r[0], *r[1]) for r in plain.collect()]
    assert sorted(map(tuple, read_array(spark, str(tmp_path / "e.json"), schema).drop("document").collect()), key=lambda r: r[0]) == want
    assert [r.ordinal for r in osm.read_elements(spark, str(tmp_path / "e.json"), "A").orderBy("id").collect()] == list(range(40))


def _text(folder):
    return "".join((folder / n).read_text() for n in sorted(os.listdir(folder)) if n.startswith("part"))


def test_documents_in_order(spark, tmp_path):
    objects = _objects(60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame([("b" if k % 3 else "a", k, json.dumps(o)) for k, o in enumerate(objects)], "doc string, k int, t string").repartition(7)
        write_ordered(rows, str(tmp_path / "out"), "doc", ["k"], F.col("t"), documents=spark.createDataFrame([("c",)], "doc string"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {d: [o for k, o in enumerate(objects) if ("b" if k % 3 else "a") == d] for d in "ab"} | {"c": []}
    assert {d: json.loads(_text(tmp_path / "out" / f"doc={d}")) for d in want} == want
    assert len([n for n in os.listdir(tmp_path / "out" / "doc=b") if n.startswith("part")]) > 1  # of several tasks
    got = {}
    for r in array_objects(spark, [str(tmp_path / "out" / f"doc={d}") for d in want], by_folder=True).collect():
        got.setdefault(r["document"][-1], {})[r["ordinal"]] = json.loads(r["text"])
    assert got == {d: dict(enumerate(v)) for d, v in want.items() if v}


def test_features_keep_the_order_of_tiles(spark, tmp_path):
    rows = spark.createDataFrame([("A", 2, 0, "Point", "[9,9]", {"k": "last"}), ("A", 1, 1, "Point", "[1,2]", {"k": "b"}), ("A", 1, 0, "Point", "[3,4]", {"k": "z"})], "city string, tile int, nth int, kind string, coordinates string, properties map<string,string>")
    write_features(rows, str(tmp_path / "f"), ["tile", "nth"])
    told = json.loads(_text(tmp_path / "f" / "city=A"))
    assert [f["properties"]["k"] for f in told["features"]] == ["z", "b", "last"] and told["features"][0]["geometry"] == {"type": "Point", "coordinates": [3, 4]}
    assert [r.feature for r in osm.read_features(spark, str(tmp_path / "f" / "city=A"), "A").collect()] == [0, 1, 2]


def test_curve():
    for z in range(5):
        cells = sorted((curve.place_of(z, x, y), x, y) for x in range(1 << z) for y in range(1 << z))
        assert [c[0] for c in cells] == list(range(curve.first_of_zoom(z), curve.first_of_zoom(z + 1)))
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(cells, cells[1:]))
        assert all(curve.tile_at(n) == (z, x, y) for n, x, y in cells)
    rng = random.Random(0)
    for _ in range(200):
        z = rng.randint(0, 6)
        x0, x1, y0, y1 = (v for _ in "xy" for v in sorted(rng.randrange(1 << z) for _ in "ab"))
        found = curve.stretches(z, x0, y0, x1, y1)
        assert {n for a, b in found for n in range(a, b + 1)} == {curve.place_of(z, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
        assert all(a[1] + 1 < b[0] for a, b in zip(found, found[1:]))


@pytest.fixture
def folder(tmp_path):
    for city in "AB":
        for z in (11, 12):
            for x in range(12):
                (tmp_path / "tiles" / city / str(z) / str(x)).mkdir(parents=True)
                for y in range(6):
                    (tmp_path / "tiles" / city / str(z) / str(x) / f"{y}.mvt").write_bytes(f"{city} {z} {x} {y}".encode())
    return tmp_path / "tiles"


def _noted(log, failures=0, what=""):
    """A reader of bytes that notes what it reads and fails at first."""

    def read(uri, *at):
        before = open(log).read().split("\n") if os.path.exists(log) else []
        with open(log, "a") as f:
            f.write(f"{uri} {at}\n")
        if what and uri.endswith(what) and sum(x.startswith(f"{uri} ") for x in before) < failures:
            raise OSError("not now")
        return file_bytes(uri, *at)

    return read


def test_only_wanted_tile_files_are_opened(spark, folder, tmp_path):
    log = str(tmp_path / "log")
    source = type("Noted", (TileFiles,), {"read_bytes": staticmethod(_noted(log, 2, "/7/3.mvt"))})
    rows = tile_table(spark, source, f"file://{folder}", ["A"], (12, 12), (5, 8), (2, 3), wait=0.01)
    assert sorted(bytes(r.payload).decode() for r in rows.collect()) == sorted(f"A 12 {x} {y}" for x in range(5, 9) for y in (2, 3))
    opened = open(log).read().split("\n")[:-1]
    assert len(set(opened)) == 8 and len(opened) == 10  # the one that failed twice was read the third time
    table = tile_table(spark, TileFiles, f"file://{folder}")
    assert table.filter("x = 1").unionAll(table.filter("x = 2 and y < 3")).count() == 36 and table.count() == 288
    assert tile_table(spark, TileFiles, f"file://{tmp_path}/nothing").count() == 0


def test_filters_are_pushed_down_to_files(spark, folder, tmp_path):
    log = str(tmp_path / "log")
    source = type("Noted", (TileFiles,), {"read_bytes": staticmethod(_noted(log))})
    table = tile_table(spark, source, f"file://{folder}", pushdown=True)
    assert table.filter("city = 'A' and z = 12 and x between 5 and 8 and y >= 2 and y < 4").count() == 8 == len(open(log).read().split("\n")) - 1
    assert table.filter("city in ('A') and x in (1, 3) and z > 11").count() == 12 and table.filter("x = 1 or y = 2").count() == 68 and table.count() == 288


def test_a_read_that_keeps_failing_is_told(spark, folder, tmp_path):
    source = type("Down", (TileFiles,), {"read_bytes": staticmethod(_noted(str(tmp_path / "log"), 99, ".mvt"))})
    with pytest.raises(Exception, match="not now"):
        tile_table(spark, source, f"file://{folder}", ["A"], (12, 12), (1, 1), (1, 1), wait=0.0, tries=3).count()


def test_known_tiles_are_fetched(spark, folder):
    wanted = spark.createDataFrame([("A", 12, 1, 2), ("B", 11, 0, 0), ("A", 12, 99, 0)], "city string, z int, x int, y int")
    assert sorted(bytes(r.payload).decode() for r in tiles.read_tiles(wanted, f"file://{folder}").collect()) == ["A 12 1 2", "B 11 0 0"]


def _numbered(values):
    out = bytearray()
    for v in values:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _directory(entries):
    """number, run, offset, length of each."""
    steps = [b[0] - a[0] for a, b in zip([(0,), *entries], entries)]
    return gzip.compress(_numbered([len(entries), *steps, *(e[1] for e in entries), *(e[3] for e in entries), *(e[2] + 1 for e in entries)]))


def _archive(tiles_, leaf_size):
    """An archive of tiles by (z, x, y); tiles of equal bytes in a row are one entry, stored once."""
    entries, data = [], b""
    for number, raw in sorted((curve.place_of(*t), raw) for t, raw in tiles_.items()):
        last = entries[-1] if entries else None
        if last and number == last[0] + last[1] and data[last[2] :] == raw:
            entries[-1] = (last[0], last[1] + 1, *last[2:])
        else:
            entries.append((number, 1, len(data), len(raw)))
            data += raw
    leaves, top = b"", entries
    if leaf_size:
        top = []
        for k in range(0, len(entries), leaf_size):
            leaf = _directory(entries[k : k + leaf_size])
            top.append((entries[k][0], 0, len(leaves), len(leaf)))
            leaves += leaf
    root = _directory(top)
    zooms = [z for z, _, _ in tiles_]
    places = struct.pack("<8Q", HEAD, len(root), 0, 0, HEAD + len(root), len(leaves), HEAD + len(root) + len(leaves), len(data))
    head = (MAGIC + bytes([VERSION]) + places).ljust(97, b"\0") + bytes([GZIP, 1, 1, min(zooms), max(zooms)])
    return head.ljust(HEAD, b"\0") + root + leaves + data, HEAD + len(root) + len(leaves)


@pytest.mark.parametrize("leaf_size", [0, 50])
def test_archive_reads_directories_and_ranges_only(spark, tmp_path, leaf_size):
    held = {(z, x, y): (b"sea" * 40 if x > 20 else f"{z} {x} {y} ".encode() * 30) for z in (4, 5) for x in range(1 << z) for y in range(1 << z) if (x, y) != (3, 3)}
    raw, tiles_at = _archive(held, leaf_size)
    (tmp_path / "a.pmtiles").write_bytes(raw)
    log = str(tmp_path / "log")
    source = type("Noted", (TileArchive,), {"read_bytes": staticmethod(_noted(log))})
    table = tile_table(spark, source, f"file://{tmp_path}/a.pmtiles", city="A", pushdown=True)
    told = lambda rows: {(r.z, r.x, r.y): bytes(r.payload) for r in rows.collect()}
    box = table.filter("city = 'A' and z = 5 and x between 2 and 6 and y between 1 and 5")
    assert told(box) == {t: v for t, v in held.items() if t[0] == 5 and 2 <= t[1] <= 6 and 1 <= t[2] <= 5}
    reads = [tuple(map(int, line.split(" (")[1].rstrip(")").split(", "))) for line in open(log).read().split("\n")[:-1]]
    assert sum(n for at, n in reads if at >= tiles_at) < (len(raw) - tiles_at) / 4
    assert told(table) == held and table.filter("city = 'B'").count() == 0
    assert told(table.filter("x > 20 and y = 7")) == {t: v for t, v in held.items() if t[1] > 20 and t[2] == 7}
    assert told(tiles_of(spark, source, f"file://{tmp_path}/a.pmtiles", "A", 5, [-179.0, 40.0, -120.0, 60.0])) == {t: v for t, v in held.items() if t[0] == 5 and t[1] <= 5 and 9 <= t[2] <= 12}


def test_a_box_skips_row_groups(spark, tmp_path, capsys):
    rng = random.Random(5)
    at = [(k, "node", rng.uniform(-10, 10), rng.uniform(-10, 10)) for k in range(4000)]
    rows = spark.createDataFrame([("A", k, kind, lon, lat, k, {"place": "quarter"}) for k, kind, lon, lat in at], "city string, id long, type string, lon double, lat double, ordinal long, tags map<string,string>")
    rows = rows.withColumn("bounds", F.struct(*[(F.lit(0.0)).alias(c) for c in ("minlat", "minlon", "maxlat", "maxlon")]))
    osm.stage_elements(rows, str(tmp_path / "staged"), group_rows=100)
    got = osm.read_staged(spark, str(tmp_path / "staged"), "A", [2.0, 2.0, 3.0, 3.5])
    assert {r.id for r in got.collect()} == {k for k, _, lon, lat in at if 2 <= lon <= 3 and 2 <= lat <= 3.5}
    got.explain("formatted")
    assert "GreaterThanOrEqual(east,2.0)" in capsys.readouterr().out
    groups = met = 0
    for name in os.listdir(tmp_path / "staged" / "city=A"):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(tmp_path / "staged" / "city=A" / name).metadata
            place = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                stat = lambda c: meta.row_group(g).column(place[c]).statistics  # noqa: B023, E731
                groups += 1
                met += stat("east").max >= 2 and stat("west").min <= 3 and stat("north").max >= 2 and stat("south").min <= 3.5
    assert groups >= 40 and met <= groups / 6


def test_layers_in_the_order_of_elements(spark, tmp_path):
    way = lambda i, o, tags: ("A", o, "way", i, [(43.6, -79.4), (43.61, -79.4)], tags)
    rows = [way(5, 1, {"highway": "trunk", "name": "B"}), way(9, 0, {"highway": "primary", "name": "A"}), way(7, 2, {"aeroway": "runway"}), way(3, 3, {"building": "yes"})]
    frame = spark.createDataFrame(rows, "city string, ordinal long, type string, id long, geometry array<struct<lat:double,lon:double>>, tags map<string,string>")
    layers.write_roads(frame, str(tmp_path / "roads"))
    layers.write_runways(frame, str(tmp_path / "runways"))
    layers.write_elements(frame.filter("id = 3"), str(tmp_path / "elements"))
    roads = json.loads(_text(tmp_path / "roads" / "city=A"))["features"]
    assert [f["properties"]["name"] for f in roads] == ["A", "B"] and roads[0]["geometry"]["coordinates"] == [[-79.4, 43.6], [-79.4, 43.61]]
    (runway,) = json.loads(_text(tmp_path / "runways" / "city=A"))["features"]
    assert runway["properties"]["z_order"] == 0 and len(runway["geometry"]["coordinates"][0]) > 20
    assert json.loads(_text(tmp_path / "elements" / "city=A")) == [{"type": "way", "id": 3, "geometry": [{"lat": 43.6, "lon": -79.4}, {"lat": 43.61, "lon": -79.4}], "tags": {"building": "yes"}}]


def test_outputs_are_switched_over_together(spark, tmp_path):
    root = f"file://{tmp_path}/YYZ"
    value = lambda n: lambda path: spark.range(n).write.parquet(path)
    rows = lambda: {k: spark.read.parquet(v).count() for k, v in publish.current(spark, root).items()}
    assert rows() == {}
    assert publish.published(spark, root, {"roads": value(1), "demand": value(2)}) == 1 and rows() == {"roads": 1, "demand": 2}

    def breaks(path):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        publish.published(spark, root, {"roads": value(3), "demand": breaks})
    assert rows() == {"roads": 1, "demand": 2}  # the run broke between two outputs
    value(5)(f"{root}/_versions/half/roads")
    with pytest.raises(publish.IncompleteVersion):
        publish.switched(spark, root, "half", ["roads", "demand"])
    assert rows() == {"roads": 1, "demand": 2} and publish.missing(spark, root, "half", ["roads", "demand"]) == ["demand"]
    value(6)(f"{root}/_versions/half/demand")
    assert publish.switched(spark, root, "half", ["roads", "demand"]) == 2 and rows() == {"roads": 5, "demand": 6}
    assert len(publish.cleared(spark, root, keep=1)) == 1 and rows() == {"roads": 5, "demand": 6}


def test_routes_are_asked_for_once(spark, tmp_path):
    asked = []

    def fetch(new):
        asked.append(sorted(r.residence_id for r in new.collect()))
        route = F.array(F.struct(F.length("request").cast("double").alias("distance"), F.lit(1.0).alias("duration"), F.from_json(F.lit("[]"), "array<struct<steps:array<struct<geometry:struct<coordinates:array<array<double>>>>>>>").alias("legs")))
        return new.withColumn("routes", F.when((F.col("residence_id") != "c") | F.lit(len(asked) > 1), route))

    table = lambda *ids: spark.createDataFrame([("A", i, "j", f"{i}{n}") for i, n in ids], "city string, residence_id string, job_id string, request string")
    at = f"{tmp_path}/routes"
    first = routing.routed_once(table(("a", ""), ("b", ""), ("c", ""), ("a", "")), at, fetch)
    assert asked == [["a", "b", "c"]] and {r.residence_id: r.routes is not None for r in first.collect()} == {"a": True, "b": True, "c": False}
    again = routing.routed_once(table(("a", ""), ("c", ""), ("d", "")), at, fetch)
    assert asked[1:] == [["c", "d"]] and {r.residence_id: (r.routes[0].distance, r.version) for r in again.collect()} == {"a": (1.0, 1), "c": (1.0, 2), "d": (1.0, 2)}
    routing.routed_once(table(("a", ""), ("c", ""), ("d", "")), at, fetch)
    assert len(asked) == 2  # nothing to ask for
    moved = routing.routed_once(table(("b", "moved")), at, fetch)
    assert asked[2:] == [["b"]] and [r.routes[0].distance for r in moved.collect()] == [6.0]


def test_covers_hold_what_their_boxes_hold(spark):
    rng = random.Random(6)
    boxes = []
    for k in range(40):
        w, s = rng.uniform(-1, 40), rng.uniform(-1, 40)
        boxes.append(("c", k, w, s, w + rng.choice([0, 0.5, 3, 30]), s + rng.choice([0, 0.5, 7, 33])))
    frame = spark.createDataFrame(boxes, "city string, polygon int, west double, south double, east double, north double")
    dims = spark.createDataFrame([("c", 0.0, 0.0, 1.0, 1.0, 37, 41)], "city string, west double, south double, cell_x double, cell_y double, columns int, rows int")
    squares = coverage.cover(frame, dims)
    flat = sorted(map(tuple, coverage.coverage_cells(frame, dims).select("polygon", "x", "y").collect()))
    assert sorted(map(tuple, coverage.cover_cells(squares).select("polygon", "x", "y").collect())) == flat
    ranges = {r.polygon: r for r in coverage.cell_ranges(frame, dims).collect()}
    n = {r.polygon: r["count"] for r in squares.groupBy("polygon").count().collect()}
    assert set(n) == set(ranges) and all(n[k] <= 4 * (r.c1 - r.c0 + r.r1 - r.r0 + 2) for k, r in ranges.items()) and max(n.values()) < 250 < 400 < max((r.c1 - r.c0 + 1) * (r.r1 - r.r0 + 1) for r in ranges.values())
    cells = spark.createDataFrame([("c", rng.randrange(37), rng.randrange(41), k) for k in range(60)], "city string, x int, y int, k int")
    want = {(r.k, p) for r in cells.collect() for p, x, y in flat if (x, y) == (r.x, r.y)}
    assert {(r.k, r.polygon) for r in coverage.covering(cells, squares, 7).collect()} == want
    asked = squares.filter("polygon < 5").withColumnRenamed("polygon", "query")
    by = {}
    for p, x, y in flat:
        by.setdefault(p, set()).add((x, y))
    assert {(r["query"], r.polygon) for r in coverage.meeting(asked, squares, 7).collect()} == {(q, p) for q in by if q < 5 for p in by if by[q] & by[p]}
