"""Queries for projection, predicates and tag rules."""

from pyspark.sql import functions as F

from geoloom.functions import geo as G, tags as T
from geoloom.functions.geo import mm
from geoloom.operators import networks as N, tiling
from geoloom.plans.network_queries import BRIDGE, DIR, GUIDES, KIND, NETVIEWS, mm_sql
from geoloom.plans.registry import query
from geoloom.plans.views import SPEC

R = "6378137e0"
MY = "LN(TAN(PI() / 4 + RADIANS({0}) / 2))"
BOX = "lat AS south, lon AS west, lat + 1e-2 AS north, lon + 2e-2 AS east"


def boxes(v):
    return v.view("node").select("node_id", F.col("lat").alias("south"), F.col("lon").alias("west"),
                                 (F.col("lat") + 0.01).alias("north"), (F.col("lon") + 0.02).alias("east"))


@query("project_xy", f"SELECT node_id, {mm_sql(x='x', y='y')} FROM pos", "pos")
def project_xy(v):
    return v.position.select("node_id", mm("x").alias("x"), mm("y").alias("y"))


@query("unproject_xy", f"""SELECT node_id, {mm_sql(
 lat=f"1e6 * DEGREES(2 * ATAN(EXP((({R} * {MY.format('0e0')}) + (y / 1024 + 5e-1) * ({R} * {MY.format('1e-2')} - {R} * {MY.format('0e0')})) / {R})) - PI() / 2)",
 lon=f"1e6 * DEGREES((x / 1024 + 5e-1) * {R} * RADIANS(1e-2) / {R})")} FROM pos""", "pos")
def unproject_xy(v):
    lat, lon = G.unproject_xy("x", "y", SPEC)
    return v.position.select("node_id", mm(lat * 1e6).alias("lat"), mm(lon * 1e6).alias("lon"))


@query("mercator_xy", f"SELECT node_id, {mm_sql(x=f'RADIANS(lon) * {R}', y=MY.format('lat') + f' * {R}')} FROM node", "node")
def mercator_xy(v):
    x, y = G.mercator_xy("lat", "lon")
    return v.view("node").select("node_id", mm(x).alias("x"), mm(y).alias("y"))


@query("mercator_latlon", f"SELECT node_id, {mm_sql(lat=f'1e6 * DEGREES(ATAN((EXP(lon * 1e8 / {R}) - EXP(-lon * 1e8 / {R})) / 2))', lon=f'1e6 * DEGREES(lat * 1e8 / {R})')} FROM node", "node")
def mercator_latlon(v):
    lat, lon = G.mercator_latlon(F.col("lat") * 1e8, F.col("lon") * 1e8)
    return v.view("node").select("node_id", mm(lat * 1e6).alias("lat"), mm(lon * 1e6).alias("lon"))


@query("mercator_bounds", f"""SELECT node_id, {mm_sql(x0=f'RADIANS(west) * {R}', y0=MY.format('south') + f' * {R}',
 x1=f'RADIANS(east) * {R}', y1=MY.format('north') + f' * {R}')} FROM (SELECT node_id, {BOX} FROM node)""", "node")
def mercator_bounds(v):
    out = G.mercator_bounds("south", "west", "north", "east")
    return boxes(v).select("node_id", *[mm(c).alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), out)])


EXT = f"(RADIANS(east) * {R} - RADIANS(west) * {R}) * COS(RADIANS((south + north) / 2))"
EYT = f"({MY.format('north')} * {R} - {MY.format('south')} * {R}) * COS(RADIANS((south + north) / 2))"


@query("ground_extent", f"SELECT node_id, {mm_sql(width=EXT, height=EYT)} FROM (SELECT node_id, {BOX} FROM node)", "node")
def ground_extent(v):
    w, h = G.ground_extent("south", "west", "north", "east")
    return boxes(v).select("node_id", mm(w).alias("width"), mm(h).alias("height"))


LATOF = "DEGREES(ATAN((EXP(({0}) / %s) - EXP(-({0}) / %s)) / 2))" % (R, R)


@query("area_bounds", f"""SELECT node_id, {mm_sql(south='1e6 * ' + LATOF.format('y - 1024 * s / 2'), north='1e6 * ' + LATOF.format('y + 1024 * s / 2'),
 west=f'1e6 * DEGREES((x - 2048 * s / 2) / {R})', east=f'1e6 * DEGREES((x + 2048 * s / 2) / {R})')}
 FROM (SELECT node_id, RADIANS(lon * 1000) * {R} AS x, {MY.format('lat * 1000')} * {R} AS y, 15e-1 / COS(RADIANS(lat * 1000)) AS s FROM node)""", "node")
def area_bounds(v):
    out = G.area_bounds(F.col("lat") * 1000, F.col("lon") * 1000, 2048.0, 1024.0, 1.5)
    return v.view("node").select("node_id", *[mm(c * 1e6).alias(n) for n, c in zip(("south", "west", "north", "east"), out)])


@query("tile_pixel", f"""SELECT node_id, {mm_sql(px=f'(RADIANS(lon) * {R} / (2 * PI() * {R}) + 5e-1) * 256 * 4096',
 py=f'(5e-1 - {MY.format("lat")} * {R} / (2 * PI() * {R})) * 256 * 4096')} FROM node""", "node")
def tile_pixel(v):
    px, py = G.tile_pixel("lat", "lon", 12)
    return v.view("node").select("node_id", mm(px).alias("px"), mm(py).alias("py"))


@query("pixel_latlon", f"""SELECT node_id, {mm_sql(lat='7e3 * ' + LATOF.format(f'(5e-1 - y / 1048576) * 2 * PI() * {R}'),
 lon=f'7e3 * DEGREES((x / 1048576 - 5e-1) * 2 * PI() * {R} / {R})')} FROM (SELECT node_id, lon * 5e7 AS x, lat * 5e7 AS y FROM node)""", "node")
def pixel_latlon(v):
    lat, lon = G.pixel_latlon(F.col("lon") * 5e7, F.col("lat") * 5e7, 12)
    return v.view("node").select("node_id", mm(lat * 7e3).alias("lat"), mm(lon * 7e3).alias("lon"))


PX = "CAST(FLOOR((RADIANS({0}) / (2 * PI()) + 5e-1) * 4096) AS BIGINT)"
PY = "CAST(FLOOR((5e-1 - %s / (2 * PI())) * 4096) AS BIGINT)" % MY


@query("covering_tiles", f"""SELECT node_id, tx, UNNEST(GENERATE_SERIES(GREATEST(0, ay), LEAST(4095, by_))) AS ty FROM
 (SELECT node_id, UNNEST(GENERATE_SERIES(GREATEST(0, ax), LEAST(4095, bx))) AS tx, ay, by_ FROM
 (SELECT node_id, {PX.format('lon')} AS ax, {PX.format('lon + 2e-1')} AS bx, {PY.format('lat + 1e-1')} AS ay, {PY.format('lat')} AS by_ FROM node))""", "node")
def covering_tiles(v):
    rows = v.view("node").select("node_id", F.col("lat").alias("south"), F.col("lon").alias("west"),
                                 (F.col("lat") + 0.1).alias("north"), (F.col("lon") + 0.2).alias("east"))
    return tiling.covering_tiles(rows, 12).select("node_id", "tx", "ty")


HAV = ("12742017.6e0 * ASIN(LEAST(1e0, SQRT(POWER(SIN(RADIANS({c} - {a}) / 2), 2) + COS(RADIANS({a})) * COS(RADIANS({c})) * "
       "POWER(SIN(RADIANS({d} - {b}) / 2), 2))))")


@query("haversine_m", f"SELECT node_id, {mm_sql(metres=HAV.format(a='lat', b='lon', c='lat * 900', d='lon * 800'))} FROM node", "node")
def haversine_m(v):
    return v.view("node").select("node_id", mm(G.haversine_m("lat", "lon", F.col("lat") * 900, F.col("lon") * 800)).alias("metres"))


@query("cell_resolution_m", f"""SELECT node_id, {mm_sql(rx=HAV.format(a='la', b='lo', c='la', d='(lo + 1e-4)'), ry=HAV.format(a='la', b='lo', c='(la - 1e-4)', d='lo'))}
 FROM (SELECT node_id, LEAST(GREATEST((lon - 2e-3) / 1e-4, 5e-1), 50 - 5e-1) * 1e-4 + 2e-3 AS lo,
 9e-3 + LEAST(GREATEST((lat - 9e-3) / -1e-4, 5e-1), 60 - 5e-1) * -1e-4 AS la FROM node)""", "node")
def cell_resolution_m(v):
    rx, ry = G.cell_resolution_m(F.lit(0.002), F.lit(0.009), F.lit(1e-4), F.lit(-1e-4), F.lit(60), F.lit(50), "lat", "lon")
    return v.view("node").select("node_id", mm(rx).alias("rx"), mm(ry).alias("ry"))


@query("valid_box", "SELECT node_id, (lat * 9e3 < north AND north < 85 AND lat * 9e3 > -85 AND west < lon * 2e4 AND lon * 2e4 <= 180) AS good "
       "FROM (SELECT *, 9e1 - lat * 2e3 AS north, lon * 1e4 AS west FROM node)", "node")
def valid_box(v):
    good = G.valid_box(F.col("lat") * 9e3, F.col("lon") * 1e4, F.lit(90.0) - F.col("lat") * 2e3, F.col("lon") * 2e4)
    return v.view("node").select("node_id", good.alias("good"))


@query("on_map", "SELECT node_id FROM pos WHERE ABS(x) <= 512 AND ABS(y) <= 512", "pos")
def on_map(v):
    return v.position.where(G.on_map("x", "y", SPEC.width, SPEC.height)).select("node_id")


@query("bbox_intersects", "SELECT catalog_id, url, date FROM asset WHERE minx < 2 AND maxx > 1 AND miny < 2 AND maxy > 1", "asset")
def bbox_intersects(v):
    one = [F.lit(float(n)) for n in (1, 1, 2, 2)]
    return v.view("asset").where(G.bbox_intersects(("minx", "miny", "maxx", "maxy"), one)).select("catalog_id", "url", "date")


@query("bbox_touches", "SELECT catalog_id, url, date FROM asset WHERE minx <= 2 AND maxx >= 1 AND miny <= 2 AND maxy >= 1", "asset")
def bbox_touches(v):
    one = [F.lit(float(n)) for n in (1, 1, 2, 2)]
    return v.view("asset").where(G.bbox_touches(("minx", "miny", "maxx", "maxy"), one)).select("catalog_id", "url", "date")


def on_ways(name, sql, column, extra="way"):
    """One tag rule evaluated on every way."""
    query(name, f"SELECT way_id, {sql} AS out FROM {extra}", "way")(lambda v: v.ways.select("way_id", column().alias("out")))


def on_nodes(name, sql, column):
    query(name, f"SELECT node_id, {sql} AS out FROM node", "node")(lambda v: v.nodes.select("node_id", column().alias("out")))


on_ways("oneway_direction", DIR, lambda: T.oneway_direction("tags"))
SPEED = "CASE k % 4 WHEN 0 THEN 50e0 WHEN 1 THEN 30 * 1.609344e0 WHEN 2 THEN 170e0 END"
on_ways("max_speed_kmh", f"CAST(FLOOR(({SPEED}) * 1000 + 0.5) AS BIGINT)", lambda: mm(T.max_speed_kmh("tags")))
on_ways("network_class", KIND, lambda: T.network_class("tags"))
LANES = "(CASE WHEN t_lanes = 'x' THEN 2 ELSE CAST(way_id % 6 AS INT) END)"
TEMPLATE = f"""CASE WHEN t_railway IS NOT NULL AND t_highway IS NULL THEN 'track/' || CASE WHEN t_railway = 'disused' THEN 'simple'
 WHEN COALESCE({SPEED}, 120) > 160 THEN 'high_speed' ELSE 'standard' END || CASE WHEN COALESCE(t_electrified, 'no') <> 'no' THEN '/catenary' ELSE '' END
 WHEN t_highway = 'footway' THEN CASE WHEN t_railway = 'tram' THEN 'town/small/tram' ELSE 'town/xsmall' END
 WHEN t_highway IS NULL THEN NULL
 WHEN {DIR} <> 0 THEN 'oneway/' || CASE WHEN t_railway = 'tram' THEN CASE WHEN {LANES} <= 2 THEN 'small/tram' ELSE 'medium/tram' END
  WHEN {LANES} <= 1 THEN 'xsmall' WHEN {LANES} = 2 THEN 'small' ELSE 'medium' END
 WHEN t_highway IN ('motorway', 'primary') AND COALESCE(t_lit, '') <> 'yes' AND COALESCE(t_railway, '') <> 'tram'
  THEN 'country/' || CASE WHEN {LANES} <= 2 THEN 'small' WHEN {LANES} <= 4 THEN 'medium' ELSE 'large' END
 ELSE 'town/' || CASE WHEN {LANES} <= 2 THEN 'small' WHEN {LANES} <= 4 THEN 'medium' ELSE 'large' END || CASE WHEN t_railway = 'tram' THEN '/tram' ELSE '' END END"""
on_ways("network_template", TEMPLATE, lambda: T.network_template("tags"))
SURFACE = "COALESCE(NULLIF(t_surface, ''), t_landuse, t_natural)"
SURFACE_KIND = f"""CASE WHEN t_landuse = 'forest' OR t_natural = 'wood' THEN 'forest' WHEN t_natural = 'scrub' THEN 'shrubs'
 WHEN {SURFACE} IN ('asphalt', 'sett') THEN 'asphalt' WHEN {SURFACE} IN ('grass', 'grassland') THEN 'grass'
 WHEN {SURFACE} IN ('gravel', 'farmland', 'construction', 'sand') THEN 'dirt' END"""
on_ways("surface_kind", SURFACE_KIND, lambda: T.surface_kind("tags"))
COVER_KIND = """CASE WHEN t_natural = 'wood' OR t_landuse = 'forest' THEN 'forest' WHEN t_natural = 'scrub' THEN 'shrubs'
 WHEN t_natural = 'grassland' OR t_landuse IN ('grass', 'farmland') THEN 'grass' WHEN t_natural = 'wetland' THEN 'wetland'
 WHEN t_natural = 'sand' THEN 'sand' WHEN t_natural = 'bare_rock' THEN 'rock' END"""
on_ways("landcover_kind", COVER_KIND, lambda: T.landcover_kind("tags"))
WATER_KIND = """CASE WHEN t_water = 'pond' OR t_landuse = 'basin' OR t_waterway IN ('stream', 'riverbank') OR t_water = 'river' THEN 'shallow'
 WHEN t_water = 'lake' OR t_landuse = 'reservoir' THEN 'lake' WHEN t_natural = 'water' THEN 'water-area'
 WHEN COALESCE(t_water, 'no') NOT IN ('', 'no') OR COALESCE(t_waterway, 'no') NOT IN ('', 'no') THEN 'metadata-only' END"""
on_ways("water_kind", WATER_KIND, lambda: T.water_kind("tags"))
MAPPED = f"""(COALESCE({WATER_KIND}, '') IN ('lake', 'water-area') OR COALESCE(t_natural, '') = 'water' OR COALESCE(t_water, '') = 'pond'
 OR COALESCE(t_landuse, '') = 'basin' OR COALESCE(t_waterway, '') = 'riverbank')"""
on_ways("water_is_area", f"CASE WHEN {MAPPED} AND COALESCE(t_area, '') = 'no' THEN NULL ELSE ({MAPPED} OR COALESCE(t_area, '') = 'yes') END",
        lambda: T.water_is_area("tags"))
on_ways("terrain_water", "(COALESCE(t_natural, '') = 'water' OR COALESCE(t_landuse, '') IN ('reservoir', 'basin') OR COALESCE(t_waterway, '') = 'riverbank')",
        lambda: T.terrain_water("tags"))
OBJECT = """CASE WHEN t_building IS NOT NULL AND t_building <> 'no' THEN CASE t_building WHEN 'house' THEN 'residential' WHEN 'office' THEN 'commercial'
 WHEN 'warehouse' THEN 'industrial' END WHEN t_amenity = 'bench' THEN 'bench' WHEN t_man_made = 'water_tower' THEN 'water_tower' END"""
on_ways("object_kind", OBJECT, lambda: T.object_kind("tags"))
on_ways("structure_flag", BRIDGE, lambda: T.structure_flag("tags", "bridge"))
WIDTH = """CASE WHEN k % 6 = 0 THEN 4e0 WHEN k % 6 = 1 THEN 35e-1 WHEN k % 6 IN (2, 3) THEN NULL WHEN k % 5 = 0 THEN 2e0 ELSE 6e0 END"""
on_ways("waterway_width", f"""(CASE WHEN t_width IS NOT NULL THEN 'width' WHEN t_est_width IS NOT NULL THEN 'est_width' ELSE 'fallback' END
 || ' ' || COALESCE(CAST(CAST({WIDTH} * 1000 AS BIGINT) AS STRING), 'none'))""",
        lambda: F.concat_ws(" ", T.waterway_width("tags", 6.0)[1], F.coalesce(mm(T.waterway_width("tags", 6.0)[0]).cast("string"), F.lit("none"))))
on_nodes("building_height_m", """CAST(FLOOR(CASE CAST(t_height AS STRING) WHEN 'tall' THEN NULL ELSE CASE WHEN t_height LIKE '% m' THEN CAST(REPLACE(t_height, ' m', '') AS DOUBLE)
 WHEN t_height LIKE '%ft' THEN CAST(REPLACE(t_height, 'ft', '') AS DOUBLE) * 0.3048e0 WHEN CAST(t_height AS DOUBLE) <= 1000 THEN CAST(t_height AS DOUBLE) END END * 1000 + 0.5) AS BIGINT)""",
         lambda: mm(T.building_height_m("tags")))
POINT_KIND = """CASE WHEN t_natural = 'tree' THEN 'tree' WHEN t_amenity = 'fountain' THEN 'fountain' WHEN t_barrier = 'bollard' THEN 'bollard'
 WHEN t_advertising = 'column' THEN 'advertising_column' END"""
on_nodes("point_object_kind", POINT_KIND, lambda: T.point_object_kind("tags"))
PLACE_KIND = "CASE WHEN t_place <> 'locality' AND t_name <> '' THEN t_place END"
on_nodes("place_kind", PLACE_KIND, lambda: T.place_kind("tags"))


@query("place_mode", f"SELECT node_id, CASE WHEN p IN ('city', 'town', 'village', 'hamlet') THEN 'town' ELSE 'marker' END AS mode FROM "
       f"(SELECT node_id, {PLACE_KIND} AS p FROM node) WHERE p IS NOT NULL", "node")
def place_mode(v):
    places = v.nodes.select("node_id", T.place_kind("tags").alias("p")).where("p IS NOT NULL")
    return places.select("node_id", T.place_mode("p", True, True).alias("mode"))


CATEGORY = """CASE o_custkey % 8 WHEN 0 THEN 'buildings' WHEN 1 THEN 'waterways' WHEN 2 THEN 'objects' WHEN 3 THEN 'surfaces' WHEN 4 THEN 'other'
 WHEN 5 THEN 'mappedObjects' END"""
TEXTURE = "CASE WHEN o_custkey % 3 = 0 THEN 'gravel' END"
MODEL = "CASE WHEN o_custkey % 5 < 3 THEN 'vegetation/oak' WHEN o_custkey % 5 = 3 THEN 'street/bench' END"
ITEM_KIND = "CASE o_orderkey % 5 WHEN 0 THEN 'bench' WHEN 1 THEN 'rock' WHEN 2 THEN 'tree' END"
ITEM_CATEGORY = f"""CASE WHEN {CATEGORY} IS NOT NULL AND {CATEGORY} <> 'other' THEN {CATEGORY} WHEN {TEXTURE} IS NOT NULL THEN 'surfaces'
 WHEN COALESCE({MODEL}, '') LIKE 'vegetation/%' THEN 'vegetation' ELSE 'objects' END"""
ITEM_SQL = f"SELECT o_orderkey AS item_id, {ITEM_CATEGORY} AS category, {ITEM_KIND} AS kind, o_orderkey % 17 = 0 AS unmatched FROM orders"


def items(v):
    """Scenery items: id, category, match kind, unmatched flag."""
    raw = v.table("orders").selectExpr("o_orderkey AS item_id", f"{CATEGORY} AS category", f"{TEXTURE} AS texture", f"{MODEL} AS model",
                                       f"{ITEM_KIND} AS kind", "o_orderkey % 17 = 0 AS unmatched")
    return raw.withColumn("category", T.scenery_category("category", "texture", "model")).select("item_id", "category", "kind", "unmatched")


@query("scenery_category", f"SELECT item_id, category FROM ({ITEM_SQL})")
def scenery_category(v):
    return items(v).select("item_id", "category")


@query("scenery_selected", f"SELECT item_id FROM ({ITEM_SQL}) WHERE category <> 'buildings' AND NOT unmatched AND COALESCE(kind, '') <> 'rock'")
def scenery_selected(v):
    return items(v).where(T.scenery_selected("category", "kind", "unmatched", {"buildings": False, "objects": True},
                                             {"rock": False, "bench": True})).select("item_id")


@query("unit_multiplier", """SELECT o_orderkey AS id, CAST(FLOOR(CASE o_custkey % 6 WHEN 0 THEN 1e0 WHEN 1 THEN 0.3048e0 WHEN 2 THEN 1200e0 / 3937
 WHEN 3 THEN 1e0 WHEN 5 THEN 1e0 END * 1e9 + 0.5) AS BIGINT) AS factor FROM orders""")
def unit_multiplier(v):
    units = "CASE o_custkey % 6 WHEN 0 THEN 'Metres ' WHEN 1 THEN 'feet' WHEN 2 THEN 'US survey foot' WHEN 3 THEN '' WHEN 4 THEN 'yard' END"
    rows = v.table("orders").selectExpr("o_orderkey AS id", f"{units} AS units")
    return rows.select("id", F.floor(T.unit_multiplier("units") * 1e9 + 0.5).alias("factor"))


@query("float32_xy", "SELECT node_id, CAST(FLOOR(CAST(CAST(x AS FLOAT) AS DOUBLE) * 1e6 + 0.5) AS BIGINT) AS x FROM pos", "pos")
def float32_xy(v):
    return v.position.select("node_id", F.floor(G.float32("x") * 1e6 + 0.5).alias("x"))


@query("inward_edge", "SELECT id, CAST(FLOOR(CASE WHEN x > 500 - 0.01e0 AND x <= 500 + 0.000001e0 THEN 500 - 0.01e0 ELSE x END * 1000 + 0.5) AS BIGINT) AS x "
       "FROM (SELECT o_orderkey AS id, 499.985e0 + (o_orderkey % 20) * 1e-3 AS x FROM orders)")
def inward_edge(v):
    rows = v.table("orders").select(F.col("o_orderkey").alias("id"), (F.lit(499.985) + (F.col("o_orderkey") % 20) * 1e-3).alias("x"))
    return rows.select("id", mm(G.inward_edge("x", F.lit(500.0))).alias("x"))


@query("node_elevation", """SELECT id, CASE WHEN metres IS NOT NULL AND datum = 'game' AND source IS NOT NULL THEN metres END AS z,
 (metres IS NOT NULL OR datum IS NOT NULL OR source IS NOT NULL) AND NOT COALESCE(metres IS NOT NULL AND datum = 'game' AND source IS NOT NULL, FALSE) AS invalid
 FROM (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey END AS metres, CASE o_custkey % 4 WHEN 0 THEN 'game' WHEN 1 THEN 'EGM96' END AS datum,
 CASE WHEN o_custkey % 5 < 3 THEN 'survey' END AS source FROM orders)""")
def node_elevation(v):
    rows = v.table("orders").selectExpr("o_orderkey AS id", "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey END AS metres",
                                        "CASE o_custkey % 4 WHEN 0 THEN 'game' WHEN 1 THEN 'EGM96' END AS datum",
                                        "CASE WHEN o_custkey % 5 < 3 THEN 'survey' END AS source")
    z, invalid = T.node_elevation("metres", "datum", "source")
    return rows.select("id", z.alias("z"), invalid.alias("invalid"))


@query("partition_bbox", f"""SELECT node_id, COUNT(*) AS parts, {mm_sql(south='MIN(1e6 * s)', east='MAX(1e6 * e)', middle='SUM(1e6 * (s + e))')} FROM
 (SELECT node_id, south + (north - south) * j / ny AS s, west + (east - west) * (i + 1) / nx AS e FROM
  (SELECT *, UNNEST(GENERATE_SERIES(0, nx - 1)) AS i FROM (SELECT *, UNNEST(GENERATE_SERIES(0, ny - 1)) AS j FROM
  (SELECT *, GREATEST(1, CAST(CEIL({EXT} / 8000) AS INT)) AS nx, GREATEST(1, CAST(CEIL({EYT} / 8000) AS INT)) AS ny FROM
  (SELECT node_id, lat AS south, lon AS west, lat + 2e-1 AS north, lon + 3e-1 AS east FROM node))))) GROUP BY node_id""", "node")
def partition_bbox(v):
    rows = v.view("node").select("node_id", F.col("lat").alias("south"), F.col("lon").alias("west"),
                                 (F.col("lat") + 0.2).alias("north"), (F.col("lon") + 0.3).alias("east"))
    parts = tiling.partition_bbox(rows, ["node_id"])
    return parts.groupBy("node_id").agg(F.count(F.lit(1)).alias("parts"), mm(F.min(F.col("south") * 1e6)).alias("south"),
                                        mm(F.max(F.col("east") * 1e6)).alias("east"),
                                        mm(F.sum((F.col("south") + F.col("east")) * 1e6)).alias("middle"))


# Overlapping boxes of several sizes, one for each customer.
BOXES = [("box", "c_custkey"), ("south", "(c_custkey * 37 % 80) / 1e4"), ("west", "(c_custkey * 53 % 80) / 1e4"),
         ("north", "(c_custkey * 37 % 80 + 5 + c_custkey % 4 * 10) / 1e4"), ("east", "(c_custkey * 53 % 80 + 5 + c_custkey % 3 * 15) / 1e4")]
_SIZE = """(RADIANS(e) - RADIANS(w)) * 6378137e0 * COS(RADIANS((s + n) / 2)) AS gw,
 (LN(TAN(PI() / 4 + RADIANS(n) / 2)) - LN(TAN(PI() / 4 + RADIANS(s) / 2))) * 6378137e0 * COS(RADIANS((s + n) / 2)) AS gh"""


@query("split_dense_parts", f"""WITH RECURSIVE b AS (SELECT {', '.join(f'{e} AS {c}' for c, e in BOXES)} FROM customer),
 t(box, part, s, w, n, e, rows) AS (SELECT box, 'p', south, west, north, east, (SELECT COUNT(*) FROM node WHERE lat >= south AND lat < north AND lon >= west AND lon < east) FROM b
 UNION ALL SELECT box, part || h, s, w, n, e, (SELECT COUNT(*) FROM node WHERE lat >= s AND lat < n AND lon >= w AND lon < e) FROM
  (SELECT box, part, h, CASE WHEN gw < gh AND h = '1' THEN (s + n) / 2 ELSE s END AS s, CASE WHEN gw >= gh AND h = '1' THEN (w + e) / 2 ELSE w END AS w,
   CASE WHEN gw < gh AND h = '0' THEN (s + n) / 2 ELSE n END AS n, CASE WHEN gw >= gh AND h = '0' THEN (w + e) / 2 ELSE e END AS e
   FROM (SELECT *, {_SIZE} FROM t) d, (VALUES ('0'), ('1')) AS v(h) WHERE rows > 12 AND GREATEST(gw, gh) > 60) c)
 SELECT box, part, rows, {', '.join(f'CAST(FLOOR({a} * 1e9 + 0.5) AS BIGINT) AS {c}' for a, c in zip('swne', ('south', 'west', 'north', 'east')))}
 FROM (SELECT *, {_SIZE} FROM t) f WHERE rows <= 12 OR GREATEST(gw, gh) <= 60""", "node")
def split_dense_parts(v):
    boxes = v.table("customer").selectExpr(*[f"{e} AS {c}" for c, e in BOXES])
    parts = tiling.split_dense_parts(v.view("node").select("node_id", "lat", "lon"), boxes, ["box"], limit=12, smallest_m=60.0)
    return parts.select("box", "part", "rows", *[F.floor(F.col(c) * 1e9 + 0.5).alias(c) for c in ("south", "west", "north", "east")])


@query("source_plan", f"""SELECT node_id, tile FROM (SELECT node_id, UNNEST(GENERATE_SERIES(CAST(FLOOR(a) AS INT), CAST(CEIL(c) AS INT) - 1)) AS la, b, d FROM
 (SELECT node_id, GREATEST(-85 + 1e-8, s - 2e-3) AS a, LEAST(85 - 1e-8, n + 2e-3) AS c, GREATEST(-180, w - g) AS b, LEAST(180, e + g) AS d FROM
 (SELECT *, 2e-3 / GREATEST(8e-2, COS(RADIANS((s + n) / 2))) AS g FROM (SELECT node_id, lat * 1000 - 5 AS s, lat * 1000 - 4 AS n, lon * 1000 - 6 AS w, lon * 1000 - 5 AS e FROM node))))
 , LATERAL (SELECT UNNEST(GENERATE_SERIES(CAST(FLOOR(b) AS INT), CAST(CEIL(d) AS INT) - 1)) AS lo)
 , LATERAL (SELECT CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || LPAD(CAST(ABS(la) AS STRING), 2, '0') || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END
 || LPAD(CAST(ABS(lo) AS STRING), 3, '0') AS tile)""", "node")
def source_plan(v):
    rows = v.view("node").select("node_id", (F.col("lat") * 1000 - 5).alias("south"), (F.col("lon") * 1000 - 6).alias("west"),
                                 (F.col("lat") * 1000 - 4).alias("north"), (F.col("lon") * 1000 - 5).alias("east"))
    return tiling.source_plan(rows).select("node_id", "tile")


@query("network_edges", GUIDES.rstrip() + f""", styled AS (SELECT way_id, {TEMPLATE} AS cls FROM way), flags AS (SELECT node_id AS node1 FROM node WHERE t_railway = 'signal')
 SELECT CASE WHEN kind = 'rail' THEN 'TRACK' ELSE 'STREET' END AS kind, cls, bridge, tunnel, COUNT(*) AS edges, COUNT(flags.node1) AS signals,
  CAST(FLOOR(SUM(g0 + (g1 - g0) * (k + 1) / n) * 1000 + 0.5) AS BIGINT) AS t1
 FROM piece JOIN styled USING (way_id) LEFT JOIN guide USING (way_id, seq) LEFT JOIN flags ON flags.node1 = piece.node1 AND kind = 'rail' AND k = n - 1 AND high = 1
 GROUP BY ALL""", NETVIEWS + " node")
def network_edges(v):
    edges = N.network_edges(v.ways, v.way_node, v.nodes, v.position, SPEC.width, SPEC.height)
    return edges.groupBy("kind", "cls", "bridge", "tunnel").agg(
        F.count(F.lit(1)).alias("edges"), F.count("signal").alias("signals"), mm(F.sum("t1")).alias("t1"))
