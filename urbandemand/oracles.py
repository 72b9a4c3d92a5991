"""SQL that makes each demand query's rows in another engine."""

from __future__ import annotations

from .driver_views import BUILDINGS_SQL, SITES_SQL
from .lookups import KNOWN_CITIES, ROAD_CLASS, SQFT_PER_JOB, SQFT_PER_RESIDENT

_R = "6371008.8E0"
_SITES = f"s0 AS ({SITES_SQL}), s AS (SELECT *, row_number() OVER (ORDER BY place_id) - 1 AS site_ord FROM s0)"
_AREA = f"abs(((0.0E0 + (radians(east) - radians(west)) * sin(radians(south))) + (radians(west) - radians(east)) * sin(radians(north)) + (radians(west) - radians(east)) * sin(radians(north)) + (radians(east) - radians(west)) * sin(radians(south)))) * ({_R} * {_R} / 2)"
_BOXES = f"b0 AS ({BUILDINGS_SQL}), b AS (SELECT *, lon - w / 2 AS west, lon + w / 2 AS east, lat - h / 2 AS south, lat + h / 2 AS north FROM b0)"


def _case(values: dict[str, object], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else f"{v}E0") for k, v in values.items()) + " END"


_CAPACITY = f"""{_BOXES},
a AS (SELECT building_id, btype, aeroway, (west + east) / 2 AS clon, (south + north) / 2 AS clat,
  {_AREA} * greatest(coalesce(CASE WHEN regexp_matches(levels, '^[0-9]+$') THEN levels::DOUBLE END, 1.0E0), 1.0E0) * 10.7639E0 AS floor FROM b),
u AS (SELECT building_id, clon, clat, aeroway, floor / {_case(SQFT_PER_RESIDENT, 'btype')} AS r, floor / {_case(SQFT_PER_JOB, 'btype')} AS j FROM a),
c AS (SELECT building_id, CASE WHEN r IS NOT NULL THEN 'resident' ELSE 'job' END AS use, floor(r)::BIGINT AS residents, (floor(j)::BIGINT * CASE WHEN aeroway = 'terminal' THEN 20 ELSE 1 END)::BIGINT AS jobs, clon AS lon, clat AS lat FROM u WHERE r IS NOT NULL OR j IS NOT NULL)"""
_NEAREST = f"""{_SITES}, {_CAPACITY},
n AS (SELECT c.building_id, c.residents, c.jobs, s.place_id, row_number() OVER (PARTITION BY c.building_id ORDER BY (c.lon - s.lon) * (c.lon - s.lon) + (c.lat - s.lat) * (c.lat - s.lat), s.site_ord) AS nth FROM c, s
  WHERE c.lon BETWEEN -79.67E0 AND -79.23E0 AND c.lat BETWEEN 43.57E0 AND 43.78E0),
near AS (SELECT * FROM n WHERE nth = 1),
cap AS (SELECT s.*, coalesce(sum(near.residents), 0)::BIGINT AS residents, coalesce(sum(near.jobs), 0)::BIGINT AS jobs FROM s LEFT JOIN near ON near.place_id = s.place_id GROUP BY ALL)"""
_SHARES = f"""{_NEAREST},
sh AS (SELECT *, residents::DOUBLE / nullif(sum(residents) OVER (), 0)::DOUBLE AS resident_share, jobs::DOUBLE / nullif(sum(jobs) OVER (), 0)::DOUBLE AS job_share FROM cap)"""


def _metres(a: str, b: str) -> str:
    s, t = f"sin(radians({b}.lat - {a}.lat) / 2)", f"sin(radians({b}.lon - {a}.lon) / 2)"
    h = f"({s} * {s} + {t} * {t} * cos(radians({a}.lat)) * cos(radians({b}.lat)))"
    return f"(2 * {_R} * atan2(sqrt({h}), sqrt(1 - {h})))"


_FLOWS = f"""{_SHARES},
f AS (SELECT h.place_id AS home, w.place_id AS work, h.site_ord AS home_ord, w.site_ord AS work_ord, w.job_share * h.residents AS flow, {_metres('h', 'w')} AS metres FROM sh h, sh w WHERE w.job_share * h.residents > 50),
t AS (SELECT *, floor(flow + 0.5E0)::BIGINT AS total, ceil(floor(flow + 0.5E0) / 400)::BIGINT AS splits FROM f),
g AS (SELECT *, unnest(range(1, splits + 1)) AS part, floor(total / splits + 0.5E0)::BIGINT AS size FROM t),
p AS (SELECT *, row_number() OVER (ORDER BY home_ord, work_ord, part) - 1 AS pop_id FROM g),
pid AS (SELECT place_id, CASE WHEN kind = 'terminal' THEN 'AIR_Terminal_' || (row_number() OVER (PARTITION BY kind ORDER BY site_ord) - 1) WHEN kind = 'university' THEN 'UNI_' || (row_number() OVER (PARTITION BY kind ORDER BY site_ord) - 1) ELSE place_id::VARCHAR END AS public_id FROM s),
np AS (SELECT x.public_id AS residence_id, y.public_id AS job_id, size, floor(metres + 0.5E0)::BIGINT AS driving_distance, floor(metres * 0.12E0 + 0.5E0)::BIGINT AS driving_seconds, pop_id::VARCHAR AS id FROM p JOIN pid x ON x.place_id = p.home JOIN pid y ON y.place_id = p.work)"""
_GRID = f"""{_BOXES}, box AS (SELECT min(west) AS w0, min(south) AS s0, max(east) AS e0, max(north) AS n0 FROM b),
dim AS (SELECT *, 0.0009E0 * (1.0E0 / cos((s0 + n0) / 2 * pi() / 180)) AS cx, ceil((e0 - w0) / (0.0009E0 * (1.0E0 / cos((s0 + n0) / 2 * pi() / 180))))::INT AS cols, ceil((n0 - s0) / 0.0009E0)::INT AS nrows FROM box),
pt AS (SELECT building_id, row_number() OVER (ORDER BY building_id) - 1 AS id, floor(((west + east) / 2 - w0) / cx)::INT AS x, floor(((south + north) / 2 - s0) / 0.0009E0)::INT AS y, cols, nrows FROM b, dim)"""
_COVER = f"""{_BOXES}, box AS (SELECT min(west) AS w0, min(south) AS s0, max(east) AS e0, max(north) AS n0 FROM b),
dim AS (SELECT *, 0.0027E0 / cos((s0 + n0) / 2 * pi() / 180) AS cx FROM box),
rng AS (SELECT building_id, greatest(0, floor((west - w0) / cx))::INT AS c0, least(ceil((e0 - w0) / cx) - 1, floor((east - w0) / cx))::INT AS c1, greatest(0, floor((south - s0) / 0.0027E0))::INT AS r0, least(ceil((n0 - s0) / 0.0027E0) - 1, floor((north - s0) / 0.0027E0))::INT AS r1 FROM b, dim),
cc AS (SELECT building_id, x, unnest(range(r0, r1 + 1))::INT AS y FROM (SELECT *, unnest(range(c0, c1 + 1))::INT AS x FROM rng WHERE c1 >= c0 AND r1 >= r0))"""
_HIGHWAYS = """k AS (SELECT ['motorway','motorway_link','trunk','primary','secondary_link','tertiary','unclassified','residential','footway','service'] AS keys),
hw AS (SELECT p_partkey AS id, keys[p_partkey % 10 + 1] AS highway, CASE WHEN p_partkey % 7 = 0 THEN p_name END AS en, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS name, CASE WHEN p_partkey % 4 < 2 THEN p_size::VARCHAR END AS ref, p_partkey % 13 = 0 AS nameless FROM part, k),
road AS (SELECT * FROM hw WHERE highway NOT IN ('footway', 'service'))"""
_CODES = "codes AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'ATL' ELSE substr(n_name, 1, 3) END AS code, n_nationkey FROM nation)"
_KNOWN = ", ".join(f"'{c}'" for c in KNOWN_CITIES)
_NUM = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

ORACLE_SQL: dict[str, str] = {
    "site_selection": f"WITH {_SITES} SELECT place_id, kind, name, lon, lat FROM s",
    "site_dedupe_coords": f"WITH {_SITES}, q AS (SELECT place_id, site_ord, row_number() OVER (PARTITION BY floor(lon * 10), floor(lat * 10) ORDER BY site_ord) AS nth FROM s) SELECT place_id, site_ord FROM q WHERE nth = 1",
    "building_capacity": f"WITH {_CAPACITY} SELECT building_id, use, residents, jobs FROM c",
    "terminal_job_boost": f"WITH {_CAPACITY} SELECT building_id, jobs FROM c WHERE building_id IN (SELECT building_id FROM b WHERE aeroway = 'terminal')",
    "unclassified_buildings": f"WITH {_BOXES} SELECT btype, count(*) AS n FROM b WHERE btype IN ('shed', 'garage') GROUP BY btype",
    "building_assignment": f"WITH {_NEAREST} SELECT building_id, place_id FROM near",
    "nearest_ring": f"WITH {_NEAREST} SELECT building_id, place_id FROM near",
    "site_capacity": f"WITH {_NEAREST} SELECT place_id, residents, jobs FROM cap",
    "site_shares": f"WITH {_SHARES} SELECT place_id, resident_share, job_share FROM sh",
    "zero_sites": f"WITH {_NEAREST} SELECT place_id FROM s WHERE place_id NOT IN (SELECT place_id FROM near)",
    "pair_distance": f"WITH {_SITES} SELECT a.place_id AS a, b.place_id AS b, floor({_metres('a', 'b')} + 0.5E0)::BIGINT AS metres, floor({_metres('a', 'b')} * 0.12E0 + 0.5E0)::BIGINT AS seconds FROM s a, s b",
    "flows": f"WITH {_FLOWS} SELECT home, work, round(flow, 6) AS flow, floor(metres + 0.5E0)::BIGINT AS metres FROM f",
    "flow_splits": f"WITH {_FLOWS} SELECT home, work, count(*) AS parts, sum(size)::BIGINT AS size FROM g GROUP BY home, work",
    "pops": f"WITH {_FLOWS} SELECT * FROM np",
    "special_ids": f"WITH {_FLOWS} SELECT place_id, public_id FROM pid",
    "point_pop_ids": f"WITH {_FLOWS}, e AS (SELECT work AS place_id, pop_id, 0 AS side FROM p UNION ALL SELECT home, pop_id, 1 FROM p), l AS (SELECT place_id, string_agg(pop_id::VARCHAR, ',' ORDER BY pop_id, side) AS ids FROM e GROUP BY place_id) SELECT pid.public_id AS id, cap.jobs, cap.residents, coalesce(l.ids, '') AS pop_ids FROM cap JOIN pid USING (place_id) LEFT JOIN l USING (place_id)",
    "site_inflow_outflow": f"WITH {_FLOWS}, i AS (SELECT work AS place_id, sum(size) AS v FROM p GROUP BY 1), o AS (SELECT home AS place_id, sum(size) AS v FROM p GROUP BY 1) SELECT place_id, coalesce(i.v, 0)::BIGINT AS inflow, coalesce(o.v, 0)::BIGINT AS outflow FROM i FULL JOIN o USING (place_id)",
    "building_bbox": f"WITH {_BOXES} SELECT building_id, west, south, east, north FROM b",
    "city_bbox": f"WITH {_BOXES} SELECT min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM b",
    "ring_area": f"WITH {_BOXES} SELECT building_id, round({_R} * {_R} * radians(east - west) * (sin(radians(north)) - sin(radians(south))), 4) AS area FROM b",
    "ring_centroid": f"WITH {_BOXES} SELECT building_id, round((west + east) / 2, 9) AS lon, round((south + north) / 2, 9) AS lat FROM b",
    "grid_dims": f"WITH {_GRID} SELECT cols AS columns, nrows AS rows, cols + 1 AS column_bounds, nrows + 1 AS row_bounds FROM dim",
    "grid_cells": f"WITH {_GRID} SELECT x, y, count(*) AS n, min(id) AS first FROM pt WHERE x BETWEEN 0 AND cols - 1 AND y BETWEEN 0 AND nrows - 1 GROUP BY x, y",
    "grid_cell_rows": f"WITH {_GRID} SELECT x || ',' || y || ',' || string_agg(id::VARCHAR, ',' ORDER BY id) AS cell FROM pt WHERE x BETWEEN 0 AND cols - 1 AND y BETWEEN 0 AND nrows - 1 GROUP BY x, y",
    "index_stats": f"WITH {_BOXES} SELECT count(*) AS count, greatest(1.0E0, max(CASE WHEN underground IS NULL THEN 1.0E0 WHEN underground = 'x' THEN NULL ELSE underground::DOUBLE END)) AS max_depth FROM b",
    "coverage_cells": f"WITH {_COVER} SELECT x, y, count(*) AS n, min(building_id) AS first FROM cc GROUP BY x, y",
    "coverage_stats": f"WITH {_BOXES} SELECT count(*) AS count, -4 AS min_depth, -4 AS max_depth FROM b",
    "multipolygon_flatten": "SELECT n_nationkey AS feature, part::INT AS part, 4 AS points, n_nationkey::DOUBLE AS x FROM (SELECT n_nationkey, unnest(range(0, n_nationkey % 3 + 1)) AS part FROM nation WHERE n_nationkey % 3 < 2)",
    "road_class": f"WITH {_HIGHWAYS} SELECT {_case(ROAD_CLASS, 'highway')} AS road_class, 'normal' AS structure, count(*) AS n FROM road GROUP BY 1",
    "street_name": f"WITH {_HIGHWAYS} SELECT id, CASE WHEN nameless THEN '' ELSE coalesce(en, name, ref, '') END AS name FROM road",
    "slug_ids": "WITH g AS (SELECT p_partkey, regexp_replace(lower(trim(' ' || p_name || '  -' || p_brand || '! ')), '\\s+', '_', 'g') AS t FROM part) SELECT p_partkey, regexp_replace(t, '[^a-z0-9_]', '', 'g') AS slug, regexp_replace(replace(t, '-', '_'), '[^a-z0-9_]', '', 'g') AS slug_dashes FROM g",
    "bbox_parse": "SELECT s_suppkey, s_suppkey::DOUBLE AS west, s_nationkey + 0.5E0 AS south, NULL::DOUBLE AS east, -100.0E0 AS north FROM supplier",
    "bbox_reorder": "SELECT s_suppkey AS place_id, concat_ws(',', s_suppkey + 1, s_suppkey, s_suppkey + 3, s_suppkey + 2) AS swne FROM supplier",
    "tag_filter_json": "WITH e AS (SELECT event_type, json_extract_string(props, '$.k')::DOUBLE AS k FROM events) SELECT event_type, count(*) AS n, sum(k) AS total FROM e WHERE k > 50 GROUP BY event_type",
    "view_state_default": f"WITH {_SITES} SELECT place_id, CASE WHEN place_id % 4 = 0 THEN 9.0E0 ELSE 13.5E0 END AS zoom, round(lat, 9) AS latitude, round(lon, 9) AS longitude, CASE WHEN place_id % 4 = 0 THEN 45.0E0 ELSE 0.0E0 END AS bearing FROM s",
    "known_city_anti": f"WITH {_CODES} SELECT code, n_nationkey FROM codes WHERE code NOT IN (SELECT code FROM codes WHERE n_nationkey % 2 = 0) AND code NOT IN ({_KNOWN})",
    "ocean_semi": f"WITH {_CODES} SELECT code, n_nationkey FROM codes WHERE code IN (SELECT code FROM codes WHERE n_nationkey % 2 = 0)",
    "missing_outputs": f"WITH {_CODES} SELECT code, o.output FROM codes, (VALUES ('roads'), ('demand')) o(output) WHERE o.output = 'demand' OR code NOT IN (SELECT code FROM codes WHERE n_nationkey % 3 = 0)",
    "city_union": f"WITH {_CODES} SELECT unnest([{_KNOWN}]) AS code UNION ALL SELECT code FROM codes",
    "tile_range": f"""WITH {_SITES}, r AS (SELECT place_id::VARCHAR AS city, floor((lon - 0.05E0 + 180) / 360 * 4096)::INT AS x0, floor((lon + 0.05E0 + 180) / 360 * 4096)::INT AS x1,
  floor((1 - ln(tan((lat + 0.05E0) * pi() / 180) + 1 / cos((lat + 0.05E0) * pi() / 180)) / pi()) / 2 * 4096)::INT AS y0, floor((1 - ln(tan((lat - 0.05E0) * pi() / 180) + 1 / cos((lat - 0.05E0) * pi() / 180)) / pi()) / 2 * 4096)::INT AS y1 FROM s)
SELECT city, 12 AS z, x, unnest(range(y0, y1 + 1))::INT AS y FROM (SELECT *, unnest(range(x0, x1 + 1))::INT AS x FROM r)""",
    "mercator_forward": f"WITH {_SITES} SELECT place_id, round(lon * (20037508.3427892E0 / 180), 4) AS x, round(ln(tan((lat + 90) * (pi() / 360))) * (20037508.3427892E0 / pi()), 4) AS y FROM s",
    "mercator_inverse": "SELECT s_suppkey AS place_id, round(s_suppkey * 1234.5E0 / 20037508.3427892E0 * 180, 9) AS lon, round(atan(exp(s_suppkey * 987.25E0 / 20037508.3427892E0 * pi())) * 360 / pi() - 90, 9) AS lat FROM supplier",
    "runway_features": f"WITH {_BOXES}, q AS (SELECT *, ['runway', 'taxiway', 'apron', 'gate'][building_id % 4 + 1] AS kind FROM b), e AS (SELECT *, CASE kind WHEN 'runway' THEN 30.0E0 WHEN 'taxiway' THEN 10.0E0 ELSE 0.0E0 END / ({_R} * pi() / 180) AS r FROM q) SELECT building_id AS id, 'runway' AS road_type, CASE WHEN kind <> 'apron' THEN 0 END AS z_order, CASE WHEN kind = 'apron' THEN kind END AS aeroway, building_id::VARCHAR AS osm_way_id, CASE WHEN kind = 'apron' THEN round({_R} * {_R} * radians(east - west) * (sin(radians(north)) - sin(radians(south))), 3) ELSE 0.0E0 END AS area, round(west - r / cos(radians(lat)), 7) AS west, round(south - r, 7) AS south, round(east + r / cos(radians(lat)), 7) AS east, round(north + r, 7) AS north FROM e WHERE kind <> 'gate'",
    "number_coercion": f"WITH g AS (SELECT p_partkey, ['12', '3.5', '3;4', '', '1d', 'inf', '.5', '-2', '1e2'][p_partkey % 9 + 1] AS v FROM part), n AS (SELECT p_partkey, v, CASE WHEN v = '' THEN 0.0E0 WHEN regexp_matches(v, '{_NUM}') THEN v::DOUBLE END AS value FROM g) SELECT p_partkey, value, greatest(coalesce(value, 1.0E0), 1.0E0) AS levels, CASE v WHEN '3;4' THEN 3.0E0 WHEN '1d' THEN 1.0E0 ELSE coalesce(value, 0.0E0) END AS leading FROM n",
    "last_wins": "SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, min(o_orderkey) AS ordinal FROM orders GROUP BY o_custkey",
    "key_order": "WITH o AS (SELECT o_orderkey, o_orderkey * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 10000000000 END AS id FROM orders) SELECT id, CASE WHEN id < 4294967295 THEN 0 ELSE 1 END AS class, CASE WHEN id < 4294967295 THEN id END AS as_number, CASE WHEN id >= 4294967295 THEN -o_orderkey END AS as_placed FROM o",
    "route_enrich": f"""WITH {_FLOWS},
q AS (SELECT np.*, (length(residence_id) + length(job_id)) % 2 = 0 AS routed FROM np)
SELECT routed, count(*) AS n, sum(CASE WHEN routed THEN 4 ELSE 0 END)::BIGINT AS points, sum(CASE WHEN routed THEN 61 ELSE driving_seconds END)::BIGINT AS seconds FROM q GROUP BY routed""",
    "element_box": f"WITH {_SITES}, {_BOXES} SELECT 'site' AS layer, place_id AS id FROM s WHERE lon BETWEEN -79.5E0 AND -79.4E0 AND lat BETWEEN 43.6E0 AND 43.7E0 UNION ALL SELECT 'building', building_id FROM b WHERE east >= -79.5E0 AND west <= -79.4E0 AND north >= 43.6E0 AND south <= 43.7E0",
    "scan_union": "SELECT p_partkey AS id, p_partkey % 3 <> 0 AS building FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 <> 3",
    "dense_ids": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS building, p_partkey AS ordinal, (p_partkey % 4 + 2)::INT AS points FROM part WHERE p_partkey % 4 >= 2",
    "raw_ids": "SELECT p_partkey AS building, (p_partkey % 4 + 2)::INT AS points FROM part WHERE p_partkey % 4 >= 2",
    "cities_cells": f"""WITH {_BOXES}, m AS (SELECT *, ['AAA', 'BBB', 'CCC'][building_id % 3 + 1] AS city FROM b),
box AS (SELECT city, min(west) AS w0, min(south) AS s0, max(east) AS e0, max(north) AS n0 FROM m GROUP BY city),
wide AS (SELECT *, 0.0009E0 * (1.0E0 / cos((s0 + n0) / 2 * pi() / 180)) AS cx FROM box),
pt AS (SELECT city, row_number() OVER (PARTITION BY city ORDER BY building_id) - 1 AS id, floor(((west + east) / 2 - w0) / cx)::INT AS x, floor(((south + north) / 2 - s0) / 0.0009E0)::INT AS y, ceil((e0 - w0) / cx)::INT AS cols, ceil((n0 - s0) / 0.0009E0)::INT AS nrows FROM m JOIN wide USING (city))
SELECT city, x, y, count(*) AS n, min(id) AS first FROM pt WHERE x BETWEEN 0 AND cols - 1 AND y BETWEEN 0 AND nrows - 1 GROUP BY city, x, y""",
    "cities_assignment": f"""WITH {_SITES}, {_CAPACITY}, n AS (SELECT c.building_id, s.place_id, row_number() OVER (PARTITION BY c.building_id ORDER BY (c.lon - s.lon) * (c.lon - s.lon) + (c.lat - s.lat) * (c.lat - s.lat), s.site_ord) AS nth FROM c JOIN s ON c.building_id % 2 = s.place_id % 2)
SELECT CASE WHEN building_id % 2 = 0 THEN 'AAA' ELSE 'BBB' END AS city, building_id, place_id FROM n WHERE nth = 1""",
    "zero_share": "WITH r AS (SELECT s_suppkey, s_nationkey::DOUBLE / nullif(s_suppkey % 3, 0)::DOUBLE AS share FROM supplier) SELECT s_suppkey, share, coalesce(share > 0.5E0, false) AS passes FROM r",
    "entered_views": "WITH v AS (SELECT s_suppkey, s_suppkey AS k, s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS ok FROM supplier) SELECT s_suppkey, CASE WHEN ok THEN CASE WHEN k % 3 = 1 THEN k::DOUBLE ELSE 12.0E0 END END AS zoom, CASE WHEN ok THEN k * 0.25E0 END AS latitude, CASE WHEN ok THEN 10.5E0 END AS longitude, CASE WHEN ok THEN CASE WHEN k % 2 = 0 THEN k * 0.5E0 ELSE 0.0E0 END END AS bearing FROM v",
    "place_rules": "SELECT n_nationkey, n_name AS code FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 AND n_nationkey % 3 <> 0 AND n_nationkey % 11 <> 0",
    "ocean_rings": "SELECT s_suppkey::VARCHAR AS city, -4 AS depth_min, CASE WHEN s_suppkey % 2 = 0 THEN round(s_suppkey * 1234.5E0 / 20037508.3427892E0 * 180, 9) ELSE (s_suppkey % 90)::DOUBLE END AS lon, CASE WHEN s_suppkey % 2 = 0 THEN round(atan(exp(s_suppkey * 987.25E0 / 20037508.3427892E0 * pi())) * 360 / pi() - 90, 9) ELSE (s_suppkey % 80)::DOUBLE END AS lat FROM supplier",
    "feature_boxes": "SELECT n_nationkey AS feature, n_nationkey::DOUBLE AS west, -0.5E0 - n_nationkey AS south, n_nationkey + 1.0E0 AS east, 10.0E0 AS north FROM nation",
    "text_pieces": "SELECT p_partkey, substr(p_name, 1, 3) || '--' || substr(p_name, 6) AS spliced, url_encode(p_brand || ' ' || p_name) AS encoded, p_name LIKE '%e' OR p_name LIKE '%n' AS ends FROM part",
    "build_stamps": "SELECT o_orderkey, strftime(o_orderdate::DATE - INTERVAL 1 DAY, '%Y%m%d') AS stamp FROM orders",
    "drawn_shapes": """WITH n AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 12 >= 10 THEN 0.00025E0 ELSE 0.0005E0 END AS r FROM nation),
l AS (SELECT n, r, n AS x0, 0 AS y0, n + 1 AS x1, 1 AS y1 FROM n WHERE n % 4 IN (1, 2) UNION ALL SELECT n, r, 0, 0, 1, 2 FROM n WHERE n % 4 = 2)
SELECT 'Polygon' AS kind, true AS is_line, round(x0 - r, 7) AS west, round(y0 - r, 7) AS south, round(x1 + r, 7) AS east, round(y1 + r, 7) AS north FROM l
UNION ALL SELECT 'Polygon', false, 0.0E0, 0.0E0, 1.0E0, 1.0E0 FROM n WHERE n % 4 = 0""",
    "line_buffer": f"""WITH {_BOXES}, q AS (SELECT *, CASE WHEN building_id % 4 = 0 THEN 30.0E0 ELSE 10.0E0 END / ({_R} * pi() / 180) AS r FROM b)
SELECT building_id AS id, 1 AS n_polygons, 1 AS n_rings, true AS is_closed, round(west - r / cos(radians(lat)), 7) AS west, round(south - r, 7) AS south, round(east + r / cos(radians(lat)), 7) AS east, round(north + r, 7) AS north FROM q""",
}
