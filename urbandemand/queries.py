"""The demand operators' queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import driver_views as views
from . import source_queries
from .functions import buffer, geo, num, text
from .functions.geo import closed
from .operators import assign, buildings, cities, coverage, demand, grid_index, roads, routing, sites
from .oracles import ORACLE_SQL
from .params import DEFAULTS
from .plans import demand as plans
from .plans import thumbnail
from .sources import osm, tiles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return sites.distinct_places(sites.with_order(sites.select_sites(views.sites(spark, sf))))


def _capacity(spark: SparkSession, sf: str) -> DataFrame:
    return sites.within(buildings.building_capacity(views.buildings(spark, sf)), views.places(spark))


def _shares(spark: SparkSession, sf: str) -> DataFrame:
    at = _sites(spark, sf)
    return demand.site_shares(demand.site_capacity(at, assign.nearest_site(_capacity(spark, sf), at)))


def _pops(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    shares = _shares(spark, sf)
    return demand.numbered_pops(demand.split_flows(demand.flows(shares))), shares


@query
def site_selection(spark, sf):
    return sites.select_sites(views.sites(spark, sf)).select("place_id", "kind", "name", "lon", "lat")


@query
def site_dedupe_coords(spark, sf):
    at = sites.with_order(sites.select_sites(views.sites(spark, sf)))
    coarse = at.withColumn("lon", F.floor(F.col("lon") * 10) / 10).withColumn("lat", F.floor(F.col("lat") * 10) / 10)
    return sites.distinct_places(coarse).select("place_id", F.col("site_ord").cast("long").alias("site_ord"))


@query
def building_capacity(spark, sf):
    return buildings.building_capacity(views.buildings(spark, sf)).select("building_id", "use", "residents", "jobs")


@query
def terminal_job_boost(spark, sf):
    rows = views.buildings(spark, sf).filter(F.col("tags")["aeroway"] == "terminal")
    return buildings.building_capacity(rows).select("building_id", "jobs")


@query
def unclassified_buildings(spark, sf):
    all_ = osm.scan(views.buildings(spark, sf), "buildings")
    known = buildings.building_capacity(all_).select(F.col("building_id").alias("id"))
    return all_.join(known, "id", "left_anti").groupBy(F.col("tags")["building"].alias("btype")).agg(F.count("*").alias("n"))


@query
def building_assignment(spark, sf):
    return assign.nearest_site(_capacity(spark, sf), _sites(spark, sf)).select("building_id", "place_id")


@query
def site_capacity(spark, sf):
    at = _sites(spark, sf)
    return demand.site_capacity(at, assign.nearest_site(_capacity(spark, sf), at)).select("place_id", "residents", "jobs")


@query
def site_shares(spark, sf):
    return _shares(spark, sf).select("place_id", "resident_share", "job_share")


@query
def zero_sites(spark, sf):
    at = _sites(spark, sf)
    near = assign.nearest_site(_capacity(spark, sf), at)
    return at.join(near, ["city", "place_id"], "left_anti").select("place_id")


@query
def pair_distance(spark, sf):
    m = F.col("metres")
    return demand.site_pairs(_sites(spark, sf)).select("a", "b", num.round_half_up(m).alias("metres"), num.round_half_up(m * DEFAULTS.seconds_per_metre).alias("seconds"))


@query
def flows(spark, sf):
    return demand.flows(_shares(spark, sf)).select("home", "work", F.round("flow", 6).alias("flow"), num.round_half_up(F.col("metres")).alias("metres"))


@query
def flow_splits(spark, sf):
    return demand.split_flows(demand.flows(_shares(spark, sf))).groupBy("home", "work").agg(F.count("*").alias("parts"), F.sum("size").alias("size"))


@query
def pops(spark, sf):
    groups, shares = _pops(spark, sf)
    return demand.named_pops(groups, shares).drop("city")


@query
def special_ids(spark, sf):
    return sites.public_ids(_sites(spark, sf)).select("place_id", "public_id")


@query
def point_pop_ids(spark, sf):
    groups, shares = _pops(spark, sf)
    return demand.demand_points(shares, groups).select("id", "jobs", "residents", F.array_join("pop_ids", ",").alias("pop_ids"))


@query
def site_inflow_outflow(spark, sf):
    return demand.site_traffic(_pops(spark, sf)[0]).select("place_id", "inflow", "outflow")


@query
def building_bbox(spark, sf):
    return views.buildings(spark, sf).select(F.col("id").alias("building_id"), geo.box_of(F.col("geometry")).alias("b")).select("building_id", "b.*")


@query
def city_bbox(spark, sf):
    return grid_index.city_box(views.buildings(spark, sf)).drop("city")


@query
def ring_area(spark, sf):
    return views.buildings(spark, sf).select(F.col("id").alias("building_id"), F.round(geo.ring_area(closed(F.col("geometry"))), 4).alias("area"))


@query
def ring_centroid(spark, sf):
    at = views.buildings(spark, sf).select(F.col("id").alias("building_id"), geo.centroid(closed(F.col("geometry"))).alias("c"))
    return at.select("building_id", F.round("c.lon", 9).alias("lon"), F.round("c.lat", 9).alias("lat"))


@query
def grid_dims(spark, sf):
    return grid_index.grid_dims(grid_index.city_box(views.buildings(spark, sf))).select("columns", "rows", "column_bounds", "row_bounds")


@query
def grid_cells(spark, sf):
    _, cells, _ = plans.building_index(views.buildings(spark, sf))
    return cells.select("x", "y", F.size("buildings").cast("long").alias("n"), F.array_min("buildings").cast("long").alias("first"))


@query
def grid_cell_rows(spark, sf):
    _, cells, _ = plans.building_index(views.buildings(spark, sf))
    return cells.select(F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"), F.array_join(F.transform("buildings", lambda b: b.cast("string")), ",")).alias("cell"))


@query
def index_stats(spark, sf):
    return grid_index.index_stats(grid_index.indexed_buildings(views.buildings(spark, sf))).select("count", "max_depth")


def _rectangles(spark, sf):
    return views.buildings(spark, sf).select("city", F.col("id").alias("polygon"), geo.box_of(F.col("geometry")).alias("b")).select("city", "polygon", "b.*")


@query
def coverage_cells(spark, sf):
    boxes = _rectangles(spark, sf)
    cells = coverage.coverage_cells(boxes, coverage.coverage_dims(coverage.union_box(boxes)))
    return cells.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("polygon").alias("first"))


@query
def coverage_stats(spark, sf):
    return coverage.coverage_stats(_rectangles(spark, sf)).drop("city")


@query
def multipolygon_flatten(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    at = F.col("n_nationkey").cast("string")
    ring = F.concat(F.lit("[["), at, F.lit(",0],["), at, F.lit(",1],[0,1],["), at, F.lit(",0]]"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "Polygon").when(F.col("n_nationkey") % 3 == 1, "MultiPolygon").otherwise("LineString")
    body = F.when(kind == "Polygon", F.concat(F.lit("["), ring, F.lit("]"))).when(kind == "MultiPolygon", F.concat(F.lit("[["), ring, F.lit("],["), ring, F.lit("]]"))).otherwise(ring)
    rows = n.select(F.lit(views.CITY).alias("city"), F.col("n_nationkey").alias("feature"), kind.alias("kind"), body.alias("coordinates"))
    return coverage.polygons(rows).select("feature", "part", F.size(F.col("rings")[0]).alias("points"), F.col("rings")[0][0][0].alias("x"))


def _highways(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    keys = ["motorway", "motorway_link", "trunk", "primary", "secondary_link", "tertiary", "unclassified", "residential", "footway", "service"]
    highway = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("p_partkey") % 10 + 1).cast("int"))
    tags = F.map_filter(
        F.create_map(F.lit("highway"), highway, F.lit("name:en"), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("\t "), F.col("p_name"), F.lit(" "))), F.lit("name"), F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")), F.lit("ref"), F.when(F.col("p_partkey") % 4 < 2, F.col("p_size").cast("string")), F.lit("noname"), F.when(F.col("p_partkey") % 13 == 0, F.lit("yes"))),
        lambda _, v: v.isNotNull(),
    )
    point = F.array(F.struct(F.lit(43.6).alias("lat"), F.lit(-79.4).alias("lon")), F.struct(F.lit(43.7).alias("lat"), F.lit(-79.3).alias("lon")))
    return p.select(F.lit(views.CITY).alias("city"), F.lit("way").alias("type"), F.col("p_partkey").alias("id"), tags.alias("tags"), point.alias("geometry"))


@query
def road_class(spark, sf):
    return roads.road_features(_highways(spark, sf)).groupBy("road_class", "structure").agg(F.count("*").alias("n"))


@query
def street_name(spark, sf):
    return roads.road_features(_highways(spark, sf)).select("id", "name")


@query
def slug_ids(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    given = F.concat(F.lit(" "), F.col("p_name"), F.lit("  -"), F.col("p_brand"), F.lit("! "))
    return p.select("p_partkey", text.slug(given).alias("slug"), text.slug(given, dashes=True).alias("slug_dashes"))


@query
def bbox_parse(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    given = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.concat(F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(".5")), F.lit("x"), F.lit("-1e2"))
    b = text.numbers(given)
    return s.select("s_suppkey", b[0].alias("west"), b[1].alias("south"), b[2].alias("east"), b[3].alias("north"))


@query
def bbox_reorder(spark, sf):
    at = sites.select_sites(views.sites(spark, sf))
    b = F.array(F.col("place_id"), F.col("place_id") + 1, F.col("place_id") + 2, F.col("place_id") + 3)
    return at.select("place_id", F.array_join(F.transform(text.south_west_north_east(b), lambda x: x.cast("string")), ",").alias("swne"))


@query
def tag_filter_json(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    tags = F.from_json("props", "map<string,string>")
    return e.select("event_type", num.number(tags["k"]).alias("k")).filter("k > 50").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query
def view_state_default(spark, sf):
    at = sites.select_sites(views.sites(spark, sf))
    given = F.when(F.col("place_id") % 4 == 0, F.struct(F.lit(9.0).alias("zoom"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit(45.0).alias("bearing")))
    v = cities.view_state(given, F.array(F.col("lon") - 1, F.col("lat") - 1, F.col("lon") + 1, F.col("lat") + 1))
    return at.select("place_id", v.alias("v")).select("place_id", "v.zoom", F.round("v.latitude", 9).alias("latitude"), F.round("v.longitude", 9).alias("longitude"), "v.bearing")


def _codes(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return n.select(F.when(F.col("n_nationkey") % 5 == 0, F.lit("ATL")).otherwise(F.substring("n_name", 1, 3)).alias("code"), "n_nationkey")


@query
def known_city_anti(spark, sf):
    have = _codes(spark, sf).filter("n_nationkey % 2 = 0").select(F.col("code").alias("city"))
    return cities.without_data(_codes(spark, sf), have)


@query
def ocean_semi(spark, sf):
    have = _codes(spark, sf).filter("n_nationkey % 2 = 0").select(F.col("code").alias("city"))
    return cities.with_data(_codes(spark, sf), have)


@query
def missing_outputs(spark, sf):
    done = _codes(spark, sf).filter("n_nationkey % 3 = 0").select(F.col("code").alias("city"), F.lit("roads").alias("output"))
    return cities.missing_outputs(_codes(spark, sf), done, ["roads", "demand"])


@query
def city_union(spark, sf):
    from .lookups import KNOWN_CITIES

    known = spark.createDataFrame([(c,) for c in KNOWN_CITIES], "code string")
    return known.unionByName(_codes(spark, sf).select("code"))


@query
def tile_range(spark, sf):
    at = sites.select_sites(views.sites(spark, sf)).select(F.col("place_id").cast("string").alias("code"), F.array(F.col("lon") - 0.05, F.col("lat") - 0.05, F.col("lon") + 0.05, F.col("lat") + 0.05).alias("bbox"))
    return tiles.tile_range(at, DEFAULTS.thumbnail_zoom)


@query
def mercator_forward(spark, sf):
    at = sites.select_sites(views.sites(spark, sf))
    return at.select("place_id", F.round(geo.mercator_x(F.col("lon")), 4).alias("x"), F.round(geo.mercator_y(F.col("lat")), 4).alias("y"))


@query
def mercator_inverse(spark, sf):
    at = sites.select_sites(views.sites(spark, sf))
    x, y = F.col("place_id") * 1234.5, F.col("place_id") * 987.25
    return at.select("place_id", F.round(geo.unmercator_lon(x), 9).alias("lon"), F.round(geo.unmercator_lat(y), 9).alias("lat"))


@query
def route_enrich(spark, sf):
    groups, shares = _pops(spark, sf)
    named = demand.named_pops(groups, shares)
    points = demand.demand_points(shares, groups)
    pair = routing.route_requests(named, points).filter(F.pmod(F.length("residence_id") + F.length("job_id"), F.lit(2)) == 0)
    step = F.struct(F.struct(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("coordinates")).alias("geometry"))
    route = F.array(F.struct((F.length("request") * 10.5).alias("distance"), F.lit(60.5).alias("duration"), F.array(F.struct(F.array(step, step).alias("steps"))).alias("legs")))
    out = routing.enriched(named, pair.select("city", "residence_id", "job_id", route.alias("routes")))
    return out.groupBy(F.col("driving_path").isNotNull().alias("routed")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("driving_path"), F.lit(0))).alias("points"), F.sum("driving_seconds").alias("seconds"))


def _edges(ring):
    """The box of a ring of points, to a hundredth of a metre or so."""
    lon, lat = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return [F.round(F.array_min(lon), 7).alias("west"), F.round(F.array_min(lat), 7).alias("south"), F.round(F.array_max(lon), 7).alias("east"), F.round(F.array_max(lat), 7).alias("north")]


@query
def runway_features(spark, sf):
    kinds = F.element_at(F.array(F.lit("runway"), F.lit("taxiway"), F.lit("apron"), F.lit("gate")), (F.col("id") % 4 + 1).cast("int"))
    rows = roads.runway_features(views.buildings(spark, sf).withColumn("tags", F.create_map(F.lit("aeroway"), kinds)))
    rows = rows.withColumn("ring", F.from_json("coordinates", "array<array<array<double>>>")[0])  # read once, not for each edge
    return rows.select("id", "road_type", "z_order", "aeroway", "osm_way_id", F.round("area", 3).alias("area"), *_edges(F.col("ring")))


@query
def nearest_ring(spark, sf):
    return assign.nearest_site(_capacity(spark, sf), _sites(spark, sf), per_cell=0.5).select("building_id", "place_id")


@query
def number_coercion(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    given = F.element_at(F.array(*[F.lit(x) for x in ("12", " 3.5 ", "3;4", "", "1d", "inf", ".5", "-2", "1e2")]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return p.select("p_partkey", num.number(given).alias("value"), num.at_least_one(given).alias("levels"), num.leading_number(given).alias("leading"))


@query
def last_wins(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.lit(views.CITY).alias("city"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ordinal"), "o_orderstatus")
    return sites.last_of_each(o, ["city", "id"]).select("id", "o_orderstatus", "ordinal")


@query
def key_order(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(10_000_000_000)).alias("id"), "o_orderkey")
    first, second, third = sites.key_order(F.col("id"), -F.col("o_orderkey"))
    return o.select("id", first.alias("class"), second.alias("as_number"), third.alias("as_placed"))


@query
def line_buffer(spark, sf):
    rows = views.buildings(spark, sf).withColumn("tags", F.create_map(F.lit("aeroway"), F.when(F.col("id") % 4 == 0, "runway").otherwise("taxiway")))
    line = roads.line_of(F.col("geometry"))
    at = roads.runway_properties(rows).select("id", buffer.buffer_metres(F.array(line), F.col("buffer_m")).alias("around"))
    ring = F.col("around")[0][0]
    return at.select("id", F.size("around").alias("n_polygons"), F.size(F.col("around")[0]).alias("n_rings"), (ring[0] == F.element_at(ring, -1)).alias("is_closed"), *_edges(ring))


@query
def element_box(spark, sf):
    box, none = F.array(*[F.lit(x) for x in (-79.5, 43.6, -79.4, 43.7)]), F.lit(None).cast("double")
    at = views.sites(spark, sf).filter(osm.in_box(box)).select(F.lit("site").alias("layer"), "id")
    near = views.buildings(spark, sf).withColumn("lon", none).withColumn("lat", none).filter(osm.in_box(box))
    return at.unionByName(near.select(F.lit("building").alias("layer"), "id"))


@query
def scan_union(spark, sf):
    aeroway = F.element_at(F.array(F.lit("runway"), F.lit("taxiway"), F.lit("apron"), F.lit("gate")), (F.col("id") % 4 + 1).cast("int"))
    tags = F.map_filter(F.create_map(F.lit("building"), F.when(F.col("id") % 3 != 0, "yes"), F.lit("aeroway"), aeroway), lambda _, v: v.isNotNull())
    rows = views.buildings(spark, sf).withColumn("tags", tags)
    return osm.unioned(osm.scan(rows, "buildings"), osm.scan(rows, "runways")).select("id", F.map_contains_key("tags", "building").alias("building"))


def _short(spark, sf):
    """Buildings of one to four points."""
    return views.buildings(spark, sf).withColumn("geometry", F.slice("geometry", F.lit(1), (F.col("id") % 4 + 1).cast("int")))


@query
def dense_ids(spark, sf):
    return grid_index.indexed_buildings(_short(spark, sf)).select("building", "ordinal", F.size("polygon").alias("points"))


@query
def raw_ids(spark, sf):
    return grid_index.indexed_buildings(_short(spark, sf), replace(DEFAULTS, compat_ordinals=True)).select("building", F.size("polygon").alias("points"))


@query
def cities_cells(spark, sf):
    city = F.element_at(F.array(F.lit("AAA"), F.lit("BBB"), F.lit("CCC")), (F.col("id") % 3 + 1).cast("int"))
    _, cells, _ = plans.building_index(views.buildings(spark, sf).withColumn("city", city))
    return cells.select("city", "x", "y", F.size("buildings").cast("long").alias("n"), F.array_min("buildings").cast("long").alias("first"))


@query
def cities_assignment(spark, sf):
    city = F.when(F.col("id") % 2 == 0, "AAA").otherwise("BBB")
    at = sites.distinct_places(sites.with_order(sites.select_sites(views.sites(spark, sf).withColumn("city", city))))
    own = buildings.building_capacity(views.buildings(spark, sf).withColumn("city", city))
    return assign.nearest_site(own, at).select("city", "building_id", "place_id")


@query
def zero_share(spark, sf):
    share = num.ratio(F.col("s_nationkey"), F.col("s_suppkey") % 3)
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", share.alias("share"), F.coalesce(share > 0.5, F.lit(False)).alias("passes"))


@query
def entered_views(spark, sf):
    k, nan = F.col("s_suppkey"), F.lit(float("nan"))
    latitude = F.when(k % 5 == 0, nan).when(k % 7 != 0, k * 0.25)
    zoom = F.when(k % 3 == 0, nan).when(k % 3 == 1, k.cast("double"))
    v = cities.entered_view(zoom, latitude, F.lit(10.5), F.when(k % 2 == 0, k * 0.5))
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", v.alias("v")).select("s_suppkey", "v.zoom", "v.latitude", "v.longitude", "v.bearing")


@query
def place_rules(spark, sf):
    n, one = F.col("n_nationkey"), F.col("n_nationkey").cast("double")
    four, gap = F.array(one, one, one, one), F.array(one, F.lit(None).cast("double"), one, one)
    bbox = F.when(n % 7 == 0, F.array(one, one, one)).when(n % 3 == 0, gap).otherwise(four)
    thumb = F.when(n % 11 == 0, F.array(one, one)).when(n % 2 == 1, four)
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(n, F.when(n % 5 == 0, " ").otherwise(F.col("n_name")).alias("code"), bbox.alias("bbox"), thumb.alias("thumbnailBbox"))
    return cities.valid_places(rows).select("n_nationkey", "code")


@query
def ocean_rings(spark, sf):
    k = F.col("s_suppkey")
    point = F.array(F.when(k % 2 == 0, k * 1234.5).otherwise(k % 90 * 1.0), F.when(k % 2 == 0, k * 987.25).otherwise(k % 80 * 1.0))
    depths = spark.read.parquet(f"{sf}/supplier.parquet").select(k.cast("string").alias("city"), F.lit(DEFAULTS.water_depth).alias("depth"), F.array(F.array(point, point)).alias("rings"))
    at = F.col("coordinates")[0][1]
    return roads.ocean_features(depths).select("city", "depth_min", F.round(at[0], 9).alias("lon"), F.round(at[1], 9).alias("lat"))


@query
def feature_boxes(spark, sf):
    n = F.col("n_nationkey")
    line = F.concat(F.lit("[["), n.cast("string"), F.lit(",-"), n.cast("string"), F.lit(".5],["), (n + 1).cast("string"), F.lit(",1e1]]"))
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(F.lit(views.CITY).alias("city"), n.alias("feature"), line.alias("coordinates"))
    return coverage.feature_boxes(rows).drop("city")


@query
def text_pieces(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", text.spliced(F.col("p_name"), 3, 2, "--").alias("spliced"), text.url_encoded(F.concat("p_brand", F.lit(" "), "p_name")).alias("encoded"), text.has_ending(F.col("p_name"), "e", "n").alias("ends"))


@query
def build_stamps(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", text.build_stamp(F.col("o_orderdate").cast("date")).alias("stamp"))


@query
def drawn_shapes(spark, sf):
    n = F.col("n_nationkey")
    kind = F.element_at(F.array(F.lit("Polygon"), F.lit("LineString"), F.lit("MultiLineString"), F.lit("Point")), (n % 4 + 1).cast("int"))
    line = F.concat(F.lit("[["), n.cast("string"), F.lit(",0],["), (n + 1).cast("string"), F.lit(",1]]"))
    body = F.when(kind == "Polygon", F.lit("[[[0,0],[0,1],[1,1],[0,0]]]")).when(kind == "LineString", line).when(kind == "MultiLineString", F.concat(F.lit("["), line, F.lit(",[[0,0],[1,2]]]"))).otherwise(F.lit("[0,0]"))
    zoom = F.create_map(F.lit("min_zoom"), (n % 12).cast("string"))
    rows = spark.read.parquet(f"{sf}/nation.parquet").select(F.lit(views.CITY).alias("city"), kind.alias("kind"), body.alias("coordinates"), zoom.alias("properties"))
    ring = F.from_json("coordinates", "array<array<array<double>>>")[0]
    return thumbnail.drawn_shapes(rows).select("kind", (F.size(ring) > 4).alias("is_line"), *_edges(ring))


QUERIES.update(source_queries.QUERIES)
ORACLE_SQL.update(source_queries.ORACLE_SQL)
