import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbandemand import driver_views, queries
from urbandemand.operators import assign, buildings, cities, coverage, demand, grid_index, roads, routing, sites
from urbandemand.params import Params
from urbandemand.plans import demand as plans
from urbandemand.sinks import document
from urbandemand.sources import osm, tiles

BOX = [-79.5, 43.5, -79.3, 43.7]


def element(i, tags, lon, lat, size=0.001, kind="way"):
    if kind == "node":
        return {"type": "node", "id": i, "lat": lat, "lon": lon, "tags": tags}
    ring = [(lat, lon), (lat, lon + size), (lat + size, lon + size), (lat + size, lon)]
    return {"type": kind, "id": i, "tags": tags, "bounds": {"minlat": lat, "minlon": lon, "maxlat": lat + size, "maxlon": lon + size}, "geometry": [{"lat": a, "lon": b} for a, b in ring]}


def read(spark, path, elements, city="YYZ"):
    path.write_text(json.dumps(elements))
    return osm.read_elements(spark, str(path), city)


@pytest.fixture()
def places(spark):
    return spark.createDataFrame([("YYZ", BOX)], "code string, bbox array<double>")


@pytest.mark.parametrize("tags,residents,jobs", [
    ({"building": "apartments", "building:levels": "12"}, 4818, None), ({"building": "yes"}, 160, None), ({"building": "yes", "building:levels": "3;4"}, 160, None),
    ({"building": "office"}, None, 642), ({"building": "train_station", "building:levels": "2"}, None, 192), ({"building": "train_station", "building:levels": "2", "aeroway": "terminal"}, None, 3840),
])
def test_capacity(spark, tmp_path, tags, residents, jobs):
    got = buildings.building_capacity(read(spark, tmp_path / "b.json", [element(1, tags, -79.4, 43.6)])).first()
    assert (got.residents, got.jobs) == (residents, jobs)


def test_buildings_left_out(spark, tmp_path):
    short = element(3, {"building": "yes"}, -79.4, 43.6)
    short["geometry"] = short["geometry"][:2]
    rows = read(spark, tmp_path / "b.json", [element(1, {"building": "shed"}, -79.4, 43.6), element(2, {}, -79.4, 43.6), short, element(4, {"building": "constructor"}, -79.4, 43.6)])
    assert buildings.building_capacity(rows).count() == 0
    indexed = grid_index.indexed_buildings(rows)
    assert indexed.count() == 3  # whatever their use


def test_last_of_an_id_counts(spark, tmp_path):
    rows = read(spark, tmp_path / "b.json", [element(1, {"building": "yes"}, -79.4, 43.6), element(1, {"building": "office"}, -79.4, 43.6)])
    assert [r.use for r in buildings.building_capacity(rows).collect()] == ["job"]


def test_site_selection(spark, tmp_path):
    rows = read(spark, tmp_path / "p.json", [
        element(5, {"place": "quarter", "name": "A"}, -79.4, 43.6, kind="node"), element(3, {"aeroway": "terminal"}, -79.4, 43.6), element(4, {"amenity": "university"}, -79.41, 43.61, kind="relation"),
        element(6, {"amenity": "cafe"}, -79.4, 43.6, kind="node"), element(7, {"place": "city"}, -79.4, 43.6, kind="node"), element(5_000_000_000, {"place": "neighbourhood"}, -79.4, 43.6, kind="node"),
    ])
    got = sites.with_order(sites.select_sites(rows))
    assert [(r.place_id, r.kind) for r in got.orderBy("site_ord").collect()] == [(3, "terminal"), (4, "university"), (5, "quarter"), (5_000_000_000, "neighbourhood")]
    assert got.filter("place_id = 3").first().lon == pytest.approx(-79.3995)
    names = {r.place_id: r.public_id for r in sites.public_ids(got).collect()}
    assert names == {3: "AIR_Terminal_0", 4: "UNI_0", 5: "5", 5_000_000_000: "5000000000"}
    assert sites.distinct_places(got).filter("lon = -79.4 and lat = 43.6").count() == 1


@pytest.mark.parametrize("flow,groups", [(50.0, []), (50.0001, [50]), (50.4, [50]), (400.0, [400]), (400.5, [201, 201]), (801.0, [267] * 3), (1201.0, [300] * 4)])
def test_threshold_and_splits(spark, flow, groups):
    rows = spark.createDataFrame([("c", 1, 1, 0, 0, flow, 0.0)], "city string, home long, work long, home_ord long, work_ord long, flow double, metres double").filter("flow > 50")
    assert [r["size"] for r in demand.split_flows(rows).collect()] == groups


def test_pruned_flows_are_all_flows(spark):
    rows = spark.range(300).select(F.lit("c").alias("city"), F.col("id").alias("place_id"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.col("id").alias("site_ord"), F.floor(F.pow(F.lit(1.05), F.col("id"))).alias("residents"), F.col("id").alias("jobs"))
    shares = demand.site_shares(rows)
    a, b = shares.select(F.col("place_id").alias("home"), "residents"), shares.select(F.col("place_id").alias("work"), "job_share")
    want = a.crossJoin(b).filter("job_share * residents > 50").count()
    assert demand.flows(shares).count() == want
    assert demand.flows(shares, Params(min_flow=0.25)).count() == a.crossJoin(b).filter("job_share * residents > 0.25").count()


def test_no_jobs_no_flows(spark):
    rows = spark.createDataFrame([("c", 1, 0.0, 0.0, 0, 500, 0)], "city string, place_id long, lon double, lat double, site_ord long, residents long, jobs long")
    shares = demand.site_shares(rows)
    assert shares.first().job_share is None and demand.flows(shares).count() == 0


@pytest.mark.parametrize("n_sites,per_cell", [(1, 2.0), (7, 2.0), (300, 2.0), (300, 0.25)])
def test_nearest_is_brute_force(spark, n_sites, per_cell):
    at = spark.range(n_sites).select(F.lit("c").alias("city"), F.col("id").alias("place_id"), (F.col("id") * 37 % 101 / 101).alias("lon"), (F.col("id") * 53 % 97 / 97).alias("lat"), F.col("id").alias("site_ord"))
    rows = spark.range(2000).select(F.lit("c").alias("city"), F.col("id").alias("building_id"), (F.col("id") * 71 % 211 / 150 - 0.2).alias("lon"), (F.col("id") * 29 % 199 / 150 - 0.2).alias("lat"))
    key = lambda df: sorted((r.building_id, r.place_id) for r in df.collect())
    assert key(assign.nearest_site(rows, at, per_cell)) == key(assign.nearest_site_brute(rows, at))
    assert assign.nearest_site(rows, at.limit(0)).count() == 0


def test_whole_plan(spark):
    sf = "/root/testdata/sf0.001"
    elements = driver_views.buildings(spark, sf).unionByName(driver_views.sites(spark, sf), allowMissingColumns=True)
    d = plans.demand_of(elements, driver_views.places(spark))
    capacity = {r.place_id: r for r in d.capacity.collect()}
    assigned = sum(r.residents for r in capacity.values())
    inside = sites.within(buildings.building_capacity(elements), driver_views.places(spark))
    assert assigned == inside.agg(F.sum("residents")).first()[0]
    pops = d.pops.collect()
    assert all(50 <= p["size"] <= 400 for p in pops)
    assert sorted(p.pop_id for p in pops) == list(range(len(pops)))
    order = [(p.home_ord, p.work_ord, p.part) for p in sorted(pops, key=lambda p: p.pop_id)]
    assert order == sorted(order)
    points = d.points.collect()
    listed = [i for p in points for i in p.pop_ids]
    assert sorted(listed) == sorted(str(p.pop_id) for p in pops for _ in range(2))
    doc = json.loads(document.demand_document(d.points, d.named).first().document)
    assert len(doc["points"]) == len(points) and [p["id"] for p in doc["pops"]] == [str(i) for i in range(len(pops))]


def test_processed_documents_are_read_back_and_rewritten(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    elements = driver_views.buildings(spark, sf).unionByName(driver_views.sites(spark, sf), allowMissingColumns=True)
    d = plans.demand_of(elements, driver_views.places(spark))
    where = str(tmp_path / "out")
    document.write_documents(document.demand_document(d.points, d.named), where)
    pop = "struct<residenceId:string,jobId:string,size:bigint,drivingDistance:bigint,drivingSeconds:bigint,id:string,drivingPath:array<array<double>>>"
    schema = f"points array<struct<id:string>>, pops array<{pop}>, city string"
    read = osm.read_processed(spark, where, schema).select("city", F.explode("pops").alias("p")).select("city", "p.*")
    want = {(r.id, r.residence_id, r["size"], r.driving_distance) for r in d.named.collect()}
    assert {(r.id, r.residenceId, r["size"], r.drivingDistance) for r in read.collect()} == want
    # Routed, and written over.
    routed = d.named.withColumn("driving_distance", F.col("driving_distance") + 1).withColumn("driving_path", F.array(F.array(F.lit(1.0), F.lit(2.0))))
    document.write_documents(document.demand_document(d.points, routed), where)
    again = osm.read_processed(spark, where, schema).select(F.explode("pops").alias("p")).select("p.*").collect()
    assert {(r.id, r.residenceId, r["size"], r.drivingDistance - 1) for r in again} == want and all(r.drivingPath == [[1.0, 2.0]] for r in again)


def test_building_numbers_by_blocks(spark):
    from urbandemand.operators.grid_index import counted

    rows = spark.createDataFrame([(c, o) for c in "ab" for o in range(0, 500, 3 + ord(c) % 2)], "city string, ordinal long")
    got = counted(rows, block=16).collect()
    for c in "ab":
        assert [r.building for r in sorted((r for r in got if r.city == c), key=lambda r: r.ordinal)] == list(range(sum(r.city == c for r in got)))


def test_nearest_in_cities_of_different_size(spark):
    rng = np.random.default_rng(11)
    place = lambda city, i, wide: (city, i, float(rng.uniform(0, wide)), float(rng.uniform(0, wide)))
    at = spark.createDataFrame([(*place(c, i, w), i) for c, w, n in (("small", 0.01, 60), ("large", 30.0, 5), ("one", 1.0, 1)) for i in range(n)], "city string, place_id long, lon double, lat double, site_ord long")
    rows = spark.createDataFrame([place(c, i, w) for c, w in (("small", 0.02), ("large", 40.0), ("one", 2.0), ("none", 1.0)) for i in range(80)], "city string, building_id long, lon double, lat double")
    key = lambda r: (r.city, r.building_id, r.place_id)
    assert sorted(map(key, assign.nearest_site(rows, at).collect())) == sorted(map(key, assign.nearest_site_brute(rows, at).collect()))


def test_runway_features(spark, tmp_path):
    import math

    bent = element(1, {"aeroway": "runway"}, -79.4, 43.6)
    bent["geometry"] = [{"lat": 43.6, "lon": -79.4}, {"lat": 43.61, "lon": -79.4}, {"lat": 43.61, "lon": -79.38}]
    apron = element(2, {"aeroway": "apron"}, -79.39, 43.6)
    got = {r.id: r for r in roads.runway_features(read(spark, tmp_path / "r.json", [bent, apron])).collect()}
    assert (got[1].z_order, got[1].area, got[1].aeroway, got[1].kind) == (0, 0.0, None, "Polygon")
    assert got[2].aeroway == "apron" and got[2].area > 0 and json.loads(got[2].coordinates)[0][0] == [apron["geometry"][0]["lon"], apron["geometry"][0]["lat"]]
    # Every corner of the ring lies 30 m from the line.
    north, east = 111195.08, 111195.08 * math.cos(math.radians(43.6066667))
    line = [(p["lon"] * east, p["lat"] * north) for p in bent["geometry"]]

    def away(x, y):
        out = []
        for (ax, ay), (bx, by) in zip(line, line[1:]):
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            out.append(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return min(out)

    ring = json.loads(got[1].coordinates)[0]
    assert ring[0] == ring[-1] and all(away(x * east, y * north) < 30.05 for x, y in ring)
    assert sum(abs(away(x * east, y * north) - 30) < 0.2 for x, y in ring) == len(ring)  # the inner corner's edges meet at 30 m from both


def test_runways_are_dealt_over_tasks(spark, tmp_path):
    """What lies around lines is found by many tasks, though the elements are one file's."""
    spark.range(1, 301).select(F.col("id").alias("p_partkey"), F.lit("name").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("line_buffer", "runway_features"):
        assert getattr(queries, name)(spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_runway_coordinates_are_read_once(spark):
    """The four edges of a ring come from one reading of its coordinates."""
    plan = queries.runway_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_thumbnail(spark):
    from urbandemand.plans.thumbnail import THIN, WIDE, drawn_shapes, thumbnails

    square = "[[[0.0,0.0],[0.1,0.0],[0.1,0.1],[0.0,0.0]]]"
    rows = [("a", "Polygon", square, {}), ("a", "MultiPolygon", f"[{square}]", {}), ("a", "LineString", "[[0.0,0.0],[0.1,0.0]]", {"min_zoom": "10"}), ("a", "MultiLineString", "[[[0.0,0.0],[0.1,0.0]],[[0.0,0.1],[0.1,0.1]]]", {"min_zoom": "9"}), ("a", "Point", "[0.0,0.0]", {}), ("b", "LineString", "[[0.0,0.0],[0.1,0.0]]", None)]
    features = spark.createDataFrame(rows, "city string, kind string, coordinates string, properties map<string,string>")
    shapes = drawn_shapes(features).collect()
    assert sorted((s.city, s.kind) for s in shapes) == [("a", "MultiPolygon")] + [("a", "Polygon")] * 4 + [("b", "Polygon")]
    low = sorted(round(min(y for _, y in json.loads(s.coordinates)[0]), 6) for s in shapes if s.coordinates != square and s.kind == "Polygon" and s.city == "a")
    assert low == [-WIDE, -THIN, round(0.1 - WIDE, 6)]
    svgs = {r.city: r.svg for r in thumbnails(features).collect()}
    assert svgs["a"].count("<path") == 5 and svgs["b"].count("<path") == 1 and all(s.endswith("</svg>") for s in svgs.values())


def test_tiles_zips_and_missing_files(spark, tmp_path):
    import zipfile

    from urbandemand.functions import text
    from urbandemand.sources import tiles

    (tmp_path / "t/a/12/3").mkdir(parents=True)
    (tmp_path / "t/a/12/3/4.mvt").write_bytes(b"xy")
    wanted = spark.createDataFrame([("a", 12, 3, 4), ("a", 12, 3, 5)], "city string, z int, x int, y int")
    assert [(r.y, bytes(r.payload)) for r in tiles.read_tiles(wanted, f"file://{tmp_path}/t").collect()] == [(4, b"xy")]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("a.json", "{}")
        z.writestr("b.txt", "no")
    (tmp_path / "bad.zip").write_bytes(b"no pack")
    assert [(r.name, bytes(r.payload)) for r in osm.read_zipped(spark, str(tmp_path / "*.zip")).collect()] == [("a.json", b"{}")]
    assert osm.read_features(spark, str(tmp_path / "none.geojson"), "a").count() == 0
    places = spark.createDataFrame([(0, "a", "first"), (1, "a", "second")], "city_ord int, code string, name string")
    assert [r.name for r in osm.place_of(places, "a").collect()] == ["first"] and osm.place_of(places, "z").count() == 0
    row = spark.range(1).select(text.spliced(F.lit("abcdef"), 1, 2, "X").alias("s"), text.url_encoded(F.lit("a b(c)~é")).alias("u"), text.has_ending(F.lit("x.json"), ".json", ".gz").alias("e")).first()
    assert (row.s, row.u, row.e) == ("aXdef", "a%20b(c)~%C3%A9", True)


def test_shared_folder_must_be_named_on_a_cluster():
    import pytest as pt

    from urbandemand.scratch import shared_dir

    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, other=None):
            return self.values.get(key, other)

    class Session:
        def __init__(self, master, path=None):
            self.conf = Conf(**{"spark.master": master, "spark.checkpoint.dir": path})

    with pt.raises(ValueError):
        shared_dir(Session("yarn"))
    assert shared_dir(Session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(Session("local[2]")).startswith("file:")


def test_building_index_document(spark, tmp_path):
    short = element(9, {"building": "yes"}, -79.41, 43.59)
    short["geometry"] = short["geometry"][:2]
    rows = read(spark, tmp_path / "b.json", [short, element(1, {"building:levels:underground": "2"}, -79.4, 43.6), element(2, {"building:levels:underground": "x"}, -79.395, 43.605), element(3, {}, -79.391, 43.609)])
    indexed, cells, stats = plans.building_index(rows)
    box = grid_index.city_box(rows)
    assert box.first().west == -79.41  # a short geometry widens the box
    assert stats.first().max_depth == 2 and stats.first()["count"] == 3
    assert sorted(r.building for r in indexed.collect()) == [0, 1, 2]
    assert sorted(r.building for r in grid_index.indexed_buildings(rows, Params(compat_ordinals=True)).collect()) == [1, 2, 3]
    doc = json.loads(document.index_document(box, grid_index.grid_dims(box), cells, indexed, stats, 0.0009).first().document)
    assert [b.get("f") for b in doc["buildings"]] == [2.0, None, 1.0] and doc["stats"] == {"count": 3, "maxDepth": 2.0}
    assert sorted(i for c in doc["cells"] for i in c[2:]) == [0, 1, 2]


def test_grid_dims(spark):
    box = spark.createDataFrame([("c", -79.40, 43.60, -79.39, 43.61)], "city string, west double, south double, east double, north double")
    r = grid_index.grid_dims(box).first()
    assert (r.columns, r.rows, r.column_bounds, r.row_bounds) == (9, 12, 10, 13) and r.cell_x == pytest.approx(0.001242902203232635)


def test_water(spark, tmp_path):
    square = [[[0, 0], [0.01, 0], [0.01, 0.01], [0, 0.01], [0, 0]]]
    body = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"kind": "lake"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square, [[[0, 0], [0.001, 0], [0, 0.001], [0, 0]]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [0.005, 0.005]]}},
    ]}
    (tmp_path / "w.json").write_text(json.dumps(body))
    features = osm.read_features(spark, str(tmp_path / "w.json"), "c")
    dims, cells = plans.water_index(features)
    assert (dims.first().columns, dims.first().rows) == (4, 4)
    assert cells.filter("polygon = 0").count() == 16 and cells.filter("polygon = 2").count() == 1
    boxes = plans.polygon_boxes(features)
    doc = json.loads(document.water_document(coverage.union_box(coverage.feature_boxes(features)), dims, cells, boxes, coverage.coverage_stats(boxes), 0.0027, -4).first().document)
    assert doc["stats"] == {"count": 3, "minDepth": -4, "maxDepth": -4} and doc["grid"] == [4, 4] and len(doc["cells"]) == 16
    ocean = roads.ocean_features(boxes.select("city", F.lit(-4).alias("depth"), "rings"))
    assert ocean.first().coordinates == square
    document.write_documents(document.feature_collection(ocean.withColumn("kind", F.lit("Polygon")), ["depth_min"]), str(tmp_path / "out"), "gzip")
    assert json.loads(spark.read.text(f"{tmp_path}/out").first().value)["features"][0]["properties"] == {"depth_min": -4}
    (tmp_path / "none.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    assert plans.water_index(osm.read_features(spark, str(tmp_path / "none.json"), "c"))[1].count() == 0


def test_zero_width_water_has_no_cells(spark):
    boxes = spark.createDataFrame([("c", 0, 1.0, 1.0, 1.0, 2.0)], "city string, polygon int, west double, south double, east double, north double")
    assert coverage.coverage_cells(boxes, coverage.coverage_dims(coverage.union_box(boxes))).count() == 0


def test_ocean_in_metres(spark):
    rows = spark.createDataFrame([("c", -4, [[[20037508.3427892, 0.0], [0.0, 0.0]]])], "city string, depth int, rings array<array<array<double>>>")
    assert roads.ocean_features(rows).first().coordinates[0][0] == [180.0, pytest.approx(0.0, abs=1e-9)]


def test_scans_and_staging(spark, tmp_path):
    rows = read(spark, tmp_path / "e.json", [element(1, {"building": "yes"}, -79.4, 43.6), element(2, {"highway": "trunk"}, -79.4, 43.6), element(3, {"aeroway": "apron"}, -79.4, 43.6), element(4, {"amenity": "cafe"}, -79.4, 43.6, kind="node"), element(5, {"highway": "footway"}, -79.4, 43.6)])
    assert {k: [r.id for r in osm.scan(rows, k).collect()] for k in ("buildings", "roads", "runways", "places")} == {"buildings": [1], "roads": [2], "runways": [3], "places": [4]}
    assert osm.unioned(osm.scan(rows, "buildings"), rows).count() == 5
    assert rows.filter(osm.in_box(F.array(*map(F.lit, BOX)))).count() == 5
    osm.stage_elements(rows, str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged")).filter("tag_highway = 'trunk'").count() == 1
    assert roads.road_features(rows).first().road_class == "major"
    assert roads.runway_properties(rows).first().aeroway == "apron"


def test_places(spark, tmp_path):
    config = {"tile-zoom-level": 16, "places": [{"code": "YYZ", "name": "Toronto", "description": "d", "bbox": BOX, "population": 2_700_000}, {"code": " ", "name": "x", "bbox": BOX}, {"code": "B", "name": "y", "bbox": BOX, "thumbnailBbox": [1.0]}]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    rows = osm.read_places(spark, str(tmp_path / "c.json"))
    assert [r.code for r in cities.valid_places(rows).collect()] == ["YYZ"]
    view = cities.city_entries(rows).filter("code = 'YYZ'").first().initialViewState
    assert (view.zoom, view.latitude, view.bearing) == (13.5, pytest.approx(43.6), 0.0)
    got = tiles.tile_range(cities.valid_places(rows), 12)
    assert got.count() > 0
    e = spark.range(1).select(cities.entered_view(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0), F.lit(None).cast("double")).alias("v"), cities.entered_view(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0), F.lit(0.0)).alias("w")).first()
    assert (e.v.zoom, e.v.bearing, e.w) == (12.0, 0.0, None)


def test_routing(spark):
    pops = spark.createDataFrame([("c", "1", "2", 60, 100, 12, "0"), ("c", "2", "2", 60, 0, 0, "1")], "city string, residence_id string, job_id string, size long, driving_distance long, driving_seconds long, id string")
    points = spark.createDataFrame([("c", "1", [1.5, 2.5]), ("c", "2", [3.5, 4.5])], "city string, id string, location array<double>")
    asked = routing.route_requests(pops, points)
    assert {r.request for r in asked.collect()} == {"3.5,4.5;1.5,2.5", "3.5,4.5;3.5,4.5"}
    route = '[{"distance": 10.5, "duration": 3.4, "legs": [{"steps": [{"geometry": {"coordinates": [[1,2],[3,4]]}}, {"geometry": {"coordinates": [[3,4]]}}]}]}]'
    kind = "array<struct<distance:double,duration:double,legs:array<struct<steps:array<struct<geometry:struct<coordinates:array<array<double>>>>>>>>>"
    got = routing.enriched(pops, asked.withColumn("routes", F.from_json(F.when(F.col("residence_id") == "1", F.lit(route)), kind)))
    r = {x.id: x for x in got.collect()}
    assert (r["0"].driving_distance, r["0"].driving_seconds, r["0"].driving_path) == (11, 3, [[1.0, 2.0], [3.0, 4.0], [3.0, 4.0]])
    assert (r["1"].driving_distance, r["1"].driving_path) == (0, None)


def test_chained(spark):
    assert plans.chained(spark.range(4), [lambda d: d.filter("id > 0"), lambda d: d.filter("id < 3")]).count() == 2


def test_pair_distance_takes_all_sites(spark, tmp_path):
    keys = [1, 2, 199, 200, 201, 202, 5000]
    spark.createDataFrame([(k, f"s{k}") for k in keys], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.a, r.b): (r.metres, r.seconds) for r in queries.pair_distance(spark, str(tmp_path)).collect()}
    assert set(got) == {(a, b) for a in keys for b in keys}
    at = {k: (math.radians(-79.67 + k * 7919 % 10007 / 10007 * 0.44), math.radians(43.57 + k * 104729 % 10009 / 10009 * 0.21)) for k in keys}
    for (a, b), (metres, seconds) in got.items():
        (x, y), (u, v) = at[a], at[b]
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        m = 2 * 6371008.8 * math.asin(math.sqrt(h))
        assert abs(metres - m) <= 0.51 and abs(seconds - 0.12 * m) <= 0.51


def test_key_order_takes_all_orders(spark, tmp_path):
    keys = range(1, 30)
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in queries.key_order(spark, str(tmp_path)).select("id", "class", "as_number", "as_placed").collect())
    assert got == sorted((k, 0, k, None) if k % 2 == 0 else (k * 10_000_000_000, 1, None, -k) for k in keys)


def test_line_buffer_takes_all_buildings(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.id: r.is_closed for r in queries.line_buffer(spark, sf).collect()}
    assert set(got) == {r.id for r in driver_views.buildings(spark, sf).select("id").collect()}
    assert all(got.values())


def test_numbers_without_a_whole_group_in_a_task(spark):
    """Hot, small and null groups, over many tasks and several levels of them."""
    import random

    from urbandemand.operators.numbering import numbered

    rng = random.Random(3)
    groups = ["hot"] * 300 + [rng.choice(["a", "b", None]) for _ in range(60)]
    rows = [(g, rng.random(), k) for k, g in enumerate(groups)]
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        frame = spark.createDataFrame(rows, "g string, x double, k int").repartition(5)
        got = numbered(frame, ["g"], [F.col("x")], "n", fan=2).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {k: n for g in set(groups) for n, (_, k) in enumerate(sorted((x, k) for h, x, k in rows if h == g))}
    assert {r.k: r.n for r in got} == want and len(got) == len(rows)


def test_no_window_over_a_city_alone(spark, capsys):
    queries.special_ids(spark, "/root/testdata/sf0.001").explain("formatted")
    queries.site_dedupe_coords(spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    windows = [line for line in plan.split("\n") if "windowspecdefinition(" in line]
    assert all("windowspecdefinition(city" not in w or "lon" in w or "_block" in w for w in windows) and "windowspecdefinition(kind" not in plan.replace("windowspecdefinition(kind#", "x") or "_block" in plan


def test_pairs_of_sites_have_no_nested_loop(spark, capsys):
    queries.pair_distance(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_of_covers_are_made_by_many_tasks(spark, tmp_path, capsys):
    """Boxes are dealt before they are cut into cells, and cells aren't shuffled."""
    from urbandemand.source_queries import cover_squares

    spark.range(1, 301).select(F.col("id").alias("p_partkey"), F.lit("name").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    cover_squares(spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out.split("Final Plan")[-1].split("\n")
    dealt = [k for k, line in enumerate(plan) if "Exchange hashpartitioning(polygon" in line and "REPARTITION" in line]
    cut = [k for k, line in enumerate(plan) if "Generate explode" in line]
    assert dealt and all(any(k > c for k in dealt) for c in cut)
    assert not [line for line in plan if "Exchange hashpartitioning(" in line and ("x#" in line or "y#" in line)]


def test_pairs_of_sites_are_made_by_many_tasks(spark):
    assert queries.pair_distance(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def _suppliers(spark, path, n):
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit("name").alias("s_name")).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_pairs_of_sites_shuffle_in_proportion_to_the_sites(spark, tmp_path):
    """Four times the sites are 16 times the pairs, but four times the rows in shuffles."""

    def shuffled(n):
        sc = spark.sparkContext._jsc.sc()
        stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
        before = set(stages())
        assert queries.pair_distance(spark, _suppliers(spark, tmp_path / str(n), n)).count() == n * n
        sc.listenerBus().waitUntilEmpty()
        return sum(rows for k, rows in stages().items() if k not in before)

    assert shuffled(8192) < 5 * shuffled(2048)


def test_pairs_of_sites_write_ids_in_few_bytes(spark, tmp_path):
    import pyarrow.parquet as pq

    queries.pair_distance(spark, _suppliers(spark, tmp_path, 4096)).write.parquet(f"{tmp_path}/out")
    groups = [m.row_group(g) for m in (pq.ParquetFile(p).metadata for p in (tmp_path / "out").glob("*.parquet")) for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 4096**2
    ids = sum(c.total_compressed_size for g in groups for c in map(g.column, range(g.num_columns)) if c.path_in_schema in ("a", "b"))
    assert ids < 0.3 * 4096**2


def test_pairs_of_sites_of_several_cities(spark):
    """Large, small and single cities, with places missing in their order."""
    sizes = {"large": 1700, "middle": 513, "small": 3, "one": 1}
    rows = [(c, k, k / 1e4, -k / 1e4, k) for c, n in sizes.items() for k in range(n) if k % 7 != 5]
    got = demand.site_pairs(spark.createDataFrame(rows, "city string, place_id long, lon double, lat double, site_ord int"))
    got = {r.city: (r.n, r.pairs, r.same) for r in got.groupBy("city").agg(F.count("*").alias("n"), F.count_distinct("a", "b").alias("pairs"), F.count_if((F.col("a") == F.col("b")) & (F.col("metres") == 0)).alias("same")).collect()}
    n = {c: sum(r[0] == c for r in rows) for c in sizes}
    assert got == {c: (k * k, k * k, k) for c, k in n.items()}
