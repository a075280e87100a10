"""Queries for grids, biomes and ordered edits."""

from pyspark.sql import functions as F

from geoloom.functions import geo as G
from geoloom.functions.geo import mm
from geoloom.operators import editing as E, networks as N, raster as R
from geoloom.operators.raster import kernel
from geoloom.plans.network_queries import MM, mm_sql
from geoloom.plans.polygon_queries import edges as area_edges
from geoloom.plans.registry import query
from geoloom.plans.views import GRID, GRID_SPAN
from geoloom.spec import BiomeOptions, GridSpec

LAYER = ["layer"]


def odd(c):
    """Whole steps of a unit that no derived height falls halfway between."""
    return F.floor(F.col(c) * 173.2050807 + 0.5)


FIELD = GridSpec(260.0, 260.0, 65, 65)            # survey grids for points
TILE = GridSpec(GRID_SPAN, GRID_SPAN, GRID, GRID)  # height layers
MAP = GridSpec(1024.0, 1024.0, 257, 257)           # the map of derived areas

GROUND = """SELECT survey, CAST(FLOOR((132.03125e0 - y) / 4.0625e0) AS BIGINT) AS row, CAST(FLOOR((x + 132.03125e0) / 4.0625e0) AS BIGINT) AS col, z
 FROM point WHERE classification = 2 AND NOT withheld AND x >= -132.03125e0 AND x < 132.03125e0 AND y > -132.03125e0 AND y <= 132.03125e0"""


@query("grid_ground_points", f"WITH g AS ({GROUND}) SELECT survey, row, col, {MM.format('SUM(z) / COUNT(*)', 'z')}, COUNT(*) AS points FROM g GROUP BY survey, row, col", "point")
def grid_ground_points(v):
    return R.grid_ground_points(v.view("point"), ["survey"], FIELD).select("survey", "row", "col", mm("z").alias("z"), "points")


@query("ground_stats", f"""WITH g AS ({GROUND}) SELECT survey, scanned, COALESCE(selected, 0) AS selected, 4225 - COALESCE(cells, 0) AS unfilled FROM
 (SELECT survey, COUNT(*) AS scanned FROM point GROUP BY 1) LEFT JOIN (SELECT survey, COUNT(*) AS selected, COUNT(DISTINCT row * 100 + col) AS cells FROM g GROUP BY 1) USING (survey)""", "point")
def ground_stats(v):
    points = v.view("point")
    return R.ground_stats(points, R.grid_ground_points(points, ["survey"], FIELD), ["survey"], FIELD)


SAMPLES = """SELECT CAST(FLOOR(l_orderkey / 4096) AS BIGINT) AS layer, CAST(FLOOR(l_orderkey / 64) AS BIGINT) % 64 AS row, l_orderkey % 64 AS col, l_returnflag AS source,
 CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS priority, MAX(CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity END) AS z FROM lineitem GROUP BY ALL"""


def samples(v):
    rows = v.table("lineitem").selectExpr(
        "CAST(FLOOR(l_orderkey / 4096) AS BIGINT) AS layer", "CAST(FLOOR(l_orderkey / 64) AS BIGINT) % 64 AS row", "l_orderkey % 64 AS col", "l_returnflag AS source",
        "CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS priority", "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity END AS z")
    return rows.groupBy("layer", "row", "col", "source", "priority").agg(F.max("z").alias("z"))


@query("first_valid", f"WITH s AS ({SAMPLES}) SELECT layer, row, col, CAST(ARG_MIN(z, priority) AS BIGINT) AS z, ARG_MIN(source, priority) AS source FROM s WHERE z IS NOT NULL GROUP BY 1, 2, 3")
def first_valid(v):
    return R.first_valid(samples(v), LAYER).withColumn("z", F.col("z").cast("long"))


@query("source_contribution", f"""WITH s AS ({SAMPLES}), w AS (SELECT layer, row, col, ARG_MIN(source, priority) AS source FROM s WHERE z IS NOT NULL GROUP BY 1, 2, 3)
 SELECT layer, source, available, COALESCE(contributed, 0) AS contributed, {MM.format('COALESCE(contributed, 0) * 100e0 / 4096', 'percent')} FROM (SELECT layer, source, COUNT(*) AS available FROM s WHERE z IS NOT NULL GROUP BY 1, 2)
 LEFT JOIN (SELECT layer, source, COUNT(*) AS contributed FROM w GROUP BY 1, 2) USING (layer, source)""")
def source_contribution(v):
    s = samples(v)
    return R.source_contribution(s, R.first_valid(s, LAYER), LAYER, 4096).withColumn("percent", mm("percent"))


@query("calibrate", "SELECT o_orderkey AS id, CAST(FLOOR((o_totalprice * 1e-2 + 3) * CASE o_custkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.3048e0 END * 1000 + 0.5) AS BIGINT) AS z FROM orders")
def calibrate(v):
    rows = v.table("orders").selectExpr("o_orderkey AS id", "o_totalprice AS z", "1e-2 AS scale", "3e0 AS off", "CASE o_custkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'foot' ELSE 'chain' END AS units")
    return rows.select("id", mm(R.calibrate("z", "scale", "off", "units")).alias("z"))


@query("scale_offset", "SELECT layer, row, col, CAST(FLOOR((z * 15e-1 - 20) * 1000 + 0.5) AS BIGINT) AS z FROM cell", "cell")
def scale_offset(v):
    return v.view("cell").select("layer", "row", "col", mm(R.scale_offset("z", 1.5, -20.0)).alias("z"))


@query("apply_mask", "SELECT layer, row, col, CASE WHEN (row + col) % 5 <> 0 THEN CAST(z AS BIGINT) END AS z FROM cell", "cell")
def apply_mask(v):
    cells = v.view("cell")
    mask = cells.select("layer", "row", "col", ((F.col("row") + F.col("col")) % 5 != 0).alias("valid"))
    return R.apply_mask(cells, mask, LAYER, F.lit(-9999.0)).withColumn("z", F.col("z").cast("long"))


@query("crop_window", "SELECT layer, row, col FROM cell WHERE row BETWEEN 7 AND 33 AND col BETWEEN 17 AND 43", "cell")
def crop_window(v):
    return R.crop_window(v.view("cell"), 10.5, 30.2, 20.1, 40.7).select("layer", "row", "col")


@query("grid_spec", "SELECT id, nx, ny, nx * ny AS cells FROM (SELECT c_custkey AS id, CAST(ROUND((256 + c_custkey % 1000 * 4) / 4e0) AS BIGINT) + 1 AS nx, CAST(ROUND((128 + c_custkey % 500 * 8) / 4e0) AS BIGINT) + 1 AS ny FROM customer) WHERE nx >= 33 AND ny >= 33")
def grid_spec(v):
    rows = v.table("customer").selectExpr("c_custkey AS id", "256 + c_custkey % 1000 * 4 AS w", "128 + c_custkey % 500 * 8 AS h")
    rows = rows.select("id", G.grid_side("w", 4.0).alias("nx"), G.grid_side("h", 4.0).alias("ny"))
    return rows.where(G.valid_grid("nx", "ny")).withColumn("cells", F.col("nx") * F.col("ny"))


REACH = 12.0
NEAR = """WITH m AS (SELECT * FROM cell WHERE z IS NULL), c AS (SELECT m.layer, m.row, m.col, v.row AS vr, v.col AS vc, v.z AS vz, ((v.row - m.row) * 4) * ((v.row - m.row) * 4) + ((v.col - m.col) * 4) * ((v.col - m.col) * 4) AS d2
  FROM m JOIN cell v ON v.layer = m.layer AND v.row BETWEEN m.row - 3 AND m.row + 3 AND v.col BETWEEN m.col - 3 AND m.col + 3 AND v.z IS NOT NULL),
 n AS (SELECT layer, row, col, ARG_MIN(vz, d2 * 1000000 + vr * 1000 + vc) AS vz, MIN(d2) AS d2 FROM c WHERE d2 <= 144 GROUP BY 1, 2, 3),
 filled AS (SELECT cell.layer, cell.row, cell.col, COALESCE(z, vz) AS z, SQRT(d2) AS d FROM cell LEFT JOIN n USING (layer, row, col)) """


@query("fill_gaps", NEAR + "SELECT layer, row, col, CAST(z AS BIGINT) AS z, CAST(FLOOR(d * 1000 + 0.5) AS BIGINT) AS d FROM filled", "cell")
def fill_gaps(v):
    return R.fill_gaps(v.view("cell"), LAYER, 4.0, 4.0, REACH).select("layer", "row", "col", F.col("z").cast("long").alias("z"), mm("filled_from").alias("d"))


@query("gap_stats", NEAR + """SELECT layer, (SELECT COUNT(*) FROM m WHERE m.layer = f.layer) AS missing, COUNT(d) AS filled, CAST(FLOOR(COALESCE(MAX(d), 0) * 1000 + 0.5) AS BIGINT) AS farthest,
 CASE WHEN (SELECT COUNT(*) FROM m WHERE m.layer = f.layer) > COUNT(d) THEN 'gap too wide' ELSE 'ok' END AS state FROM filled f GROUP BY layer""", "cell")
def gap_stats(v):
    cells = v.view("cell")
    return R.gap_stats(cells, R.fill_gaps(cells, LAYER, 4.0, 4.0, REACH), LAYER).withColumn("farthest", mm("farthest"))


SIGMA = 1.25
WEIGHTS = ", ".join(f"({i - len(kernel(SIGMA)) // 2}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(kernel(SIGMA)))


@query("gaussian_smooth", f"""WITH wt AS (SELECT * FROM (VALUES {WEIGHTS}) AS t(k, w)), ex AS (SELECT layer, row, MAX(col) AS mc FROM dense GROUP BY 1, 2),
 ac AS (SELECT d.layer, d.row, d.col, SUM(w * s.z) AS z FROM dense d JOIN ex USING (layer, row) CROSS JOIN wt JOIN dense s ON s.layer = d.layer AND s.row = d.row AND s.col = GREATEST(0, LEAST(mc, d.col + k)) GROUP BY 1, 2, 3),
 ey AS (SELECT layer, col, MAX(row) AS mr FROM dense GROUP BY 1, 2)
 SELECT d.layer, d.row, d.col, CAST(FLOOR(SUM(w * s.z) * 100 + 0.5) AS BIGINT) AS z FROM ac d JOIN ey USING (layer, col) CROSS JOIN wt JOIN ac s ON s.layer = d.layer AND s.col = d.col AND s.row = GREATEST(0, LEAST(mr, d.row + k)) GROUP BY 1, 2, 3""", "dense")
def gaussian_smooth(v):
    return R.gaussian_smooth(v.view("dense"), LAYER, SIGMA, SIGMA).select("layer", "row", "col", F.floor(F.col("z") * 100 + 0.5).alias("z"))


SLOPE = """SELECT layer, row, col, z, DEGREES(ATAN(SQRT(gx * gx + gy * gy))) AS slope FROM (SELECT *,
 (COALESCE(LEAD(z) OVER c, z) - COALESCE(LAG(z) OVER c, z)) / CASE WHEN LEAD(z) OVER c IS NULL OR LAG(z) OVER c IS NULL THEN 4e0 ELSE 8e0 END AS gx,
 (COALESCE(LEAD(z) OVER r, z) - COALESCE(LAG(z) OVER r, z)) / CASE WHEN LEAD(z) OVER r IS NULL OR LAG(z) OVER r IS NULL THEN 4e0 ELSE 8e0 END AS gy
 FROM dense WINDOW c AS (PARTITION BY layer, row ORDER BY col), r AS (PARTITION BY layer, col ORDER BY row))"""


@query("terrain_slope", f"SELECT layer, row, col, {MM.format('slope', 'slope')} FROM ({SLOPE})", "dense")
def terrain_slope(v):
    return R.terrain_slope(v.view("dense"), LAYER, 4.0, 4.0).select("layer", "row", "col", mm("slope").alias("slope"))


SITE = """SELECT c_custkey AS id, CAST(FLOOR(c_custkey / 410) AS BIGINT) AS layer, ((c_custkey * 37) % 2600) / 10e0 - 13e1 AS x, ((c_custkey * 53) % 2600) / 10e0 - 13e1 AS y FROM customer"""
SITED = f"""WITH site AS ({SITE}), q AS (SELECT *, LEAST(63, GREATEST(0, (x / 252 + 5e-1) * 63)) AS fc, LEAST(63, GREATEST(0, (5e-1 - y / 252) * 63)) AS fr FROM site),
 tap AS (SELECT id, layer, LEAST(63, CAST(FLOOR(fr) AS BIGINT) + i) AS row, LEAST(63, CAST(FLOOR(fc) AS BIGINT) + j) AS col,
  (CASE i WHEN 0 THEN 1 - (fr - FLOOR(fr)) ELSE fr - FLOOR(fr) END) * (CASE j WHEN 0 THEN 1 - (fc - FLOOR(fc)) ELSE fc - FLOOR(fc) END) AS w FROM q, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)),
 hit AS (SELECT id, SUM(w * z) / SUM(w) AS z FROM (SELECT * FROM tap WHERE w <> 0) JOIN {{0}} USING (layer, row, col) WHERE z IS NOT NULL GROUP BY id HAVING SUM(w) > 1e-9) """


def sites(v):
    return v.table("customer").selectExpr("c_custkey AS id", "CAST(FLOOR(c_custkey / 410) AS BIGINT) AS layer", "((c_custkey * 37) % 2600) / 10D - 13e1 AS x", "((c_custkey * 53) % 2600) / 10D - 13e1 AS y")


@query("sample_at_points", SITED.replace("{0}", "dense") + "SELECT site.id, CAST(FLOOR(z * 173.2050807e0 + 0.5) AS BIGINT) AS z FROM site LEFT JOIN hit USING (id)", "dense")
def sample_at_points(v):
    return R.sample_at_points(v.view("dense"), sites(v), LAYER, ["id"], TILE).select("id", odd("z").alias("z"))


@query("resample_grid", SITED.replace("{0}", "cell") + "SELECT site.id, CAST(FLOOR(z * 173.2050807e0 + 0.5) AS BIGINT) AS z FROM site LEFT JOIN hit USING (id)", "cell")
def resample_grid(v):
    return R.sample_at_points(v.view("cell"), sites(v), LAYER, ["id"], TILE).select("id", odd("z").alias("z"))


CUBE = "CASE WHEN ABS({0}) <= 1 THEN 15e-1 * POWER(ABS({0}), 3) - 25e-1 * POWER({0}, 2) + 1 ELSE -5e-1 * POWER(ABS({0}), 3) + 25e-1 * POWER({0}, 2) - 4 * ABS({0}) + 2 END"


@query("resample_cubic", f"""WITH q AS (SELECT layer, row AS r, col AS c, row + 25e-2 AS fr, col * 5e-1 AS fc FROM dense),
 tap AS (SELECT layer, r, c, CAST(FLOOR(fr) AS BIGINT) + i AS row, CAST(FLOOR(fc) AS BIGINT) + j AS col, ({CUBE.format('(fr - FLOOR(fr) - i)')}) * ({CUBE.format('(fc - FLOOR(fc) - j)')}) AS w
  FROM q, (VALUES (-1), (0), (1), (2)) AS a(i), (VALUES (-1), (0), (1), (2)) AS b(j)),
 hit AS (SELECT layer, r, c, SUM(w * z) / SUM(w) AS z FROM tap JOIN cell USING (layer, row, col) WHERE z IS NOT NULL AND w <> 0 GROUP BY 1, 2, 3 HAVING ABS(SUM(w)) > 1e-9)
 SELECT q.layer, q.r, q.c, CAST(FLOOR(z * 173.2050807e0 + 0.5) AS BIGINT) AS z FROM q LEFT JOIN hit USING (layer, r, c)""", "dense cell")
def resample_cubic(v):
    targets = v.view("dense").select("layer", F.col("row").alias("r"), F.col("col").alias("c"), (F.col("row") + 0.25).alias("frow"), (F.col("col") * 0.5).alias("fcol"))
    return R.resample_grid(v.view("cell"), targets, LAYER, ["r", "c"], "Cubic").select("layer", "r", "c", odd("z").alias("z"))


@query("resample_nearest", "SELECT d.layer, d.row AS r, d.col AS c, CAST(s.z AS BIGINT) AS z FROM dense d LEFT JOIN cell s ON s.layer = d.layer AND s.row = FLOOR(d.row * 5e-1 + 5e-1) AND s.col = FLOOR(d.col * 75e-2 + 5e-1)", "dense cell")
def resample_nearest(v):
    targets = v.view("dense").select("layer", F.col("row").alias("r"), F.col("col").alias("c"), (F.col("row") * 0.5).alias("frow"), (F.col("col") * 0.75).alias("fcol"))
    return R.resample_grid(v.view("cell"), targets, LAYER, ["r", "c"], "Nearest").select("layer", "r", "c", F.col("z").cast("long").alias("z"))


@query("reference_heights", SITED.replace("{0}", "dense") + "SELECT site.id, CAST(FLOOR(z * 173.2050807e0 + 0.5) AS BIGINT) AS z FROM site LEFT JOIN hit USING (id)", "dense")
def reference_heights(v):
    return R.reference_heights(sites(v), v.view("dense"), LAYER, TILE).select("id", odd("z").alias("z"))


@query("water_bed_heights", SITED.replace("{0}", "dense") + "SELECT site.id, CAST(FLOOR((z - 5e-1) * 173.2050807e0 + 0.5) AS BIGINT) AS z FROM site LEFT JOIN hit USING (id)", "dense")
def water_bed_heights(v):
    return R.water_bed_heights(sites(v), v.view("dense"), LAYER, TILE).select("id", odd("z").alias("z"))


@query("estimate_structure_heights", SITED.replace("{0}", "dense") + f"""SELECT a.id, {mm_sql(z0='173.2050807e-3 * (h.z * 75e-2 + g.z * 25e-2 - CASE WHEN a.id % 2 = 0 THEN 8 * SIN(25e-2 * PI()) ELSE 0 END)',
 z1='173.2050807e-3 * (h.z * 5e-1 + g.z * 5e-1 - CASE WHEN a.id % 2 = 0 THEN 8 * SIN(5e-1 * PI()) ELSE 0 END)')} FROM site a JOIN site b ON b.layer = a.layer AND b.id = a.id + 1 LEFT JOIN hit h ON h.id = a.id LEFT JOIN hit g ON g.id = b.id""", "dense")
def estimate_structure_heights(v):
    s = sites(v)
    b = s.select((F.col("id") - 1).alias("id"), "layer", F.col("x").alias("gx1"), F.col("y").alias("gy1"))
    guides = s.withColumnsRenamed({"x": "gx0", "y": "gy0"}).join(b, ["id", "layer"]).withColumns(
        {"t0": F.lit(0.25), "t1": F.lit(0.5), "tunnel": F.col("id") % 2 == 0, "depth": F.lit(8.0)})
    out = R.estimate_structure_heights(guides, v.view("dense"), LAYER, ["id"], TILE)
    return out.select("id", odd("z0").alias("z0"), odd("z1").alias("z1"))


LATTICE = """SELECT o_custkey AS map_id, o_orderkey AS source, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS priority, (o_orderkey % 3) * 1e0 AS x0, 0e0 AS y0, CASE WHEN o_orderkey % 5 = 0 THEN 2e0 ELSE 1e0 END AS dx,
 -1e0 AS dy, 'EPSG:3857' AS crs, 1e0 AS scale, 0e0 AS off, 1e0 AS factor, CASE WHEN o_orderkey % 7 < 5 THEN 'RH2000' ELSE 'EGM96' END AS datum FROM orders"""


@query("lattice_neighbours", f"""WITH s AS ({LATTICE}), f AS (SELECT *, CASE WHEN LAG(datum) OVER w = datum AND LAG(dx) OVER w = dx AND CAST(ABS(x0 - LAG(x0) OVER w) AS BIGINT) % CAST(dx AS BIGINT) = 0 THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY map_id ORDER BY priority))
 SELECT map_id, source, CAST(SUM(fresh) OVER (PARTITION BY map_id ORDER BY priority) AS BIGINT) AS mosaic FROM f""")
def lattice_neighbours(v):
    from pyspark.sql import Window
    rows = v.table("orders").selectExpr(
        "o_custkey AS map_id", "o_orderkey AS source", "(o_orderkey % 3) * 1e0 AS x0", "0e0 AS y0", "CASE WHEN o_orderkey % 5 = 0 THEN 2e0 ELSE 1e0 END AS dx", "-1e0 AS dy",
        "'EPSG:3857' AS crs", "1e0 AS scale", "0e0 AS off", "1e0 AS factor", "CASE WHEN o_orderkey % 7 < 5 THEN 'RH2000' ELSE 'EGM96' END AS datum")
    rows = rows.withColumn("priority", F.row_number().over(Window.partitionBy("map_id").orderBy("source")))
    return R.lattice_neighbours(rows, ["map_id"]).select("map_id", "source", "mosaic")


@query("mosaic_sources", """SELECT h.layer, h.row, h.col, CAST(FLOOR(SUM(a.z * 25e-2) / SUM(25e-2) * 1000 + 0.5) AS BIGINT) AS z FROM dense h
 JOIN dense a ON a.layer = h.layer AND a.row BETWEEN h.row AND h.row + 1 AND a.col BETWEEN h.col AND h.col + 1 GROUP BY h.layer, h.row, h.col""", "dense")
def mosaic_sources(v):
    # Each layer is cut into a west and an east file; the joined result equals the uncut grid.
    d = v.view("dense")
    east = F.col("col") >= 30
    cells = d.select("layer", F.when(east, "e").otherwise("w").alias("source"), "row", F.when(east, F.col("col") - 30).otherwise(F.col("col")).alias("col"), "z")
    sources = d.select("layer").distinct().withColumn("source", F.explode(F.array(F.lit("w"), F.lit("e")))).withColumns({
        "priority": F.when(F.col("source") == "w", 1).otherwise(2), "x0": F.when(F.col("source") == "w", 0.0).otherwise(30.0), "y0": F.lit(64.0), "dx": F.lit(1.0),
        "dy": F.lit(-1.0), "crs": F.lit("EPSG:3857"), "scale": F.lit(1.0), "off": F.lit(0.0), "factor": F.lit(1.0), "datum": F.lit("d")})
    # Targets lie on the corners of cells; at the border only the neighbours that exist count.
    targets = d.select("layer", "row", "col", (F.col("col") + 1.0).alias("x"), (F.lit(64.0) - F.col("row") - 1.0).alias("y"))
    out, _ = R.mosaic_sources(cells, sources, targets, LAYER)
    return out.select("layer", "row", "col", mm("z").alias("z"))


BURN = """WITH cross_ AS (SELECT e.area_id, r AS row, LEAST(257, GREATEST(0, CAST(CEIL((x0 + (512 - r * 4e0 - y0) * (x1 - x0) / (y1 - y0) + 512) / 4e0) AS BIGINT))) AS k FROM ring_edge e, LATERAL (SELECT UNNEST(GENERATE_SERIES(0, 256)) AS r)
  WHERE (y0 > 512 - r * 4e0) <> (y1 > 512 - r * 4e0)),
 o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY area_id, row ORDER BY k) AS i, LEAD(k) OVER (PARTITION BY area_id, row ORDER BY k) AS n FROM cross_),
 burned AS (SELECT row, UNNEST(GENERATE_SERIES(k, n - 1)) AS col, area_id FROM o WHERE i % 2 = 1 AND n > k) """


@query("rasterize_polygons", BURN + "SELECT row, col, MAX(area_id) AS value FROM burned GROUP BY row, col", "ring_edge")
def rasterize_polygons(v):
    values = v.areas.select("area_id", F.col("area_id").alias("value"), F.col("area_id").alias("ord"))
    return R.rasterize_polygons(area_edges(v), "area_id", values, MAP)


@query("carve_lakes", """WITH wet AS (SELECT layer, row, col, z, row % 16 BETWEEN 4 AND 11 AND col % 16 BETWEEN 4 AND 11 AS w FROM dense),
 near AS (SELECT a.layer, a.row, a.col, MIN(((b.row - a.row) * 4) * ((b.row - a.row) * 4) + ((b.col - a.col) * 4) * ((b.col - a.col) * 4)) AS d2 FROM wet a JOIN wet b ON b.layer = a.layer AND NOT b.w
  AND ABS(b.row - a.row) <= 3 AND ABS(b.col - a.col) <= 3 WHERE a.w GROUP BY 1, 2, 3)
 SELECT wet.layer, wet.row, wet.col, CAST(FLOOR((z + CASE WHEN w THEN LEAST(1e0, COALESCE(CASE WHEN d2 <= 100 THEN SQRT(d2) / 10 END, 1e0)) ELSE 0 END * (LEAST(z, 110e0) - z)) * 1000 + 0.5) AS BIGINT) AS z FROM wet LEFT JOIN near USING (layer, row, col)""", "dense")
def carve_lakes(v):
    d = v.view("dense")
    return R.carve_lakes(d, d.where("row % 16 BETWEEN 4 AND 11 AND col % 16 BETWEEN 4 AND 11"), LAYER, 4.0, 4.0, 110.0, 10.0).withColumn("z", mm("z"))


@query("elevation_range", f"SELECT layer, {mm_sql(low='MIN(z)', high='MAX(z)', largest_change='MAX(ABS(z - (z * 15e-1 - 60)))')} FROM dense GROUP BY layer", "dense")
def elevation_range(v):
    d = v.view("dense")
    return R.elevation_range(d, d.withColumn("z", F.col("z") * 1.5 - 60), LAYER).select("layer", *[mm(c).alias(c) for c in ("low", "high", "largest_change")])


@query("encode_heights", """SELECT layer, row, col, CAST(ROUND_EVEN((z * 11e-1 - lo) / (hi - lo) * 65535, 0) AS INT) AS code FROM dense JOIN
 (SELECT layer, FLOOR(MIN(z * 11e-1)) AS lo, CEIL(MAX(z * 11e-1)) AS hi FROM dense GROUP BY layer) USING (layer)""", "dense")
def encode_heights(v):
    return R.encode_heights(v.view("dense").withColumn("z", F.col("z") * 1.1), LAYER).select("layer", "row", "col", "code")


@query("encode_manual", """SELECT layer, row, col, CAST(ROUND_EVEN(LEAST(1, GREATEST(0, (z - 120) / 100)) * 65535, 0) AS INT) AS code, z < 120 OR z > 220 AS clipped FROM dense""", "dense")
def encode_manual(v):
    return R.encode_heights(v.view("dense"), LAYER, (120.0, 220.0)).select("layer", "row", "col", "code", "clipped")


def _preview_sql():
    """The preview by window functions, from the fixed values of the operator."""
    edge = lambda part, order: f"(LAST_VALUE(z) OVER {part} - FIRST_VALUE(z) OVER {part}) / (4e0 * GREATEST(COUNT(*) OVER {part} - 1, 1))"
    colours = []
    for i, (name, water) in enumerate(zip("rgb", R.WATER), 1):
        parts = [f"{float(R.STOPS[0][i])}e0"] + [f"LEAST(GREATEST((t - {t0}e0) / {t1 - t0!r}e0, 0e0), 1e0) * ({b - a})" for (t0, a), (t1, b) in
                                               zip([(s[0], s[i]) for s in R.STOPS], [(s[0], s[i]) for s in R.STOPS[1:]])]
        colours.append(f"CASE WHEN z < 104 THEN {water} ELSE CAST(FLOOR(LEAST(GREATEST(({' + '.join(parts)}) * s, 0e0), 255e0)) AS INT) END AS {name}")
    return f"""WITH g AS (SELECT *, {edge('wr', 'col')} AS gx, {edge('wc', 'row')} AS gy FROM dense
 WINDOW wr AS (PARTITION BY layer, row ORDER BY col ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), wc AS (PARTITION BY layer, col ORDER BY row ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 p AS (SELECT *, LEAST(GREATEST((z - MIN(z) OVER l) / GREATEST(1e0, MAX(z) OVER l - MIN(z) OVER l), 0e0), 1e0) AS t,
  LEAST(GREATEST((gx * -4e-1 + gy * 3e-1 + 6e-1) / SQRT(gx ** 2 + gy ** 2 + 1), 25e-2), 1e0) / 8e-1 AS s FROM g WINDOW l AS (PARTITION BY layer))
 SELECT layer, row, col, {', '.join(colours)} FROM p"""


@query("hillshade_preview", _preview_sql(), "dense")
def hillshade_preview(v):
    return R.hillshade_preview(v.view("dense"), LAYER, 4.0, 4.0, 104.0)


OPTIONS = BiomeOptions(highland_m=150.0, alpine_m=200.0, rock_slope=60.0, water_level=106.0)
STAMP = """SELECT layer, row, col, ARG_MAX(biome, seq) AS biome FROM (SELECT *, UNNEST(GENERATE_SERIES(GREATEST(0, CAST(CEIL((x - radius + 126) / 4) AS BIGINT)), LEAST(63, CAST(FLOOR((x + radius + 126) / 4) AS BIGINT)))) AS col FROM
 (SELECT *, UNNEST(GENERATE_SERIES(GREATEST(0, CAST(CEIL((126 - y - radius) / 4) AS BIGINT)), LEAST(63, CAST(FLOOR((126 - y + radius) / 4) AS BIGINT)))) AS row FROM stroke))
 WHERE (col * 4 - 126 - x) * (col * 4 - 126 - x) + (126 - row * 4 - y) * (126 - row * 4 - y) <= radius * radius GROUP BY 1, 2, 3"""
BIOMES = f"""WITH sl AS ({SLOPE}), painted AS ({STAMP}) SELECT layer, row, col, COALESCE(p.biome, CASE WHEN z < 106 THEN 0 WHEN (row + col) % 11 = 0 THEN 1 WHEN z >= 200 OR slope >= 60 THEN 4 WHEN z >= 150 THEN 3 ELSE 2 END) AS biome
 FROM sl LEFT JOIN painted p USING (layer, row, col)"""


def biomes(v):
    cells = R.terrain_slope(v.view("dense"), LAYER, 4.0, 4.0)
    cover = v.view("dense").where("(row + col) % 11 = 0").select("layer", "row", "col", F.lit(1).alias("biome"))
    return R.classify_biomes(cells, LAYER, OPTIONS, cover, E.paint_latest(v.view("stroke"), LAYER, TILE))


query("classify_biomes", BIOMES, "dense stroke")(biomes)
query("paint_latest", STAMP, "stroke")(lambda v: E.paint_latest(v.view("stroke"), LAYER, TILE))


@query("paint_biomes", f"WITH painted AS ({STAMP}) SELECT layer, row, col, COALESCE(p.biome, 2) AS biome FROM dense LEFT JOIN painted p USING (layer, row, col)", "dense stroke")
def paint_biomes(v):
    return E.paint_biomes(v.view("dense").select("layer", "row", "col", F.lit(2).alias("biome")), v.view("stroke"), LAYER, TILE)


@query("biome_histogram", f"""WITH b AS ({BIOMES}) SELECT layer, biome, (SELECT COUNT(*) FROM b WHERE b.layer = l.layer AND b.biome = t.biome) AS vertices,
 CAST(FLOOR((SELECT COUNT(*) FROM b WHERE b.layer = l.layer AND b.biome = t.biome) * 100e0 / n * 1000 + 0.5) AS BIGINT) AS percent FROM (SELECT layer, COUNT(*) AS n FROM b GROUP BY layer) l, (VALUES (0), (1), (2), (3), (4)) AS t(biome)""", "dense stroke")
def biome_histogram(v):
    return R.biome_histogram(biomes(v), LAYER).withColumn("percent", mm("percent"))


@query("import_biomes", "SELECT CASE WHEN o_custkey % 7 < 5 THEN 'ok' ELSE 'bad' END AS state, CASE WHEN o_custkey % 7 < 5 THEN CAST(o_custkey % 7 AS INT) END AS biome, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def import_biomes(v):
    code = F.get(F.array(*[F.lit(c) for c in (0, 63, 127, 191, 255, 12, 200)]), (F.col("o_custkey") % 7).cast("int"))
    good, bad = R.import_biomes(v.table("orders").select("o_orderkey", code.alias("code")))
    count = lambda df, s: df.groupBy(F.lit(s).alias("state"), "biome").agg(F.count(F.lit(1)).alias("n"))
    return count(good, "ok").unionByName(count(bad.withColumn("biome", F.lit(None).cast("int")), "bad"))


CELLS_OF = """SELECT *, (col * 4 - 126 - x) * (col * 4 - 126 - x) + (126 - row * 4 - y) * (126 - row * 4 - y) AS d2 FROM (SELECT *, UNNEST(GENERATE_SERIES(GREATEST(0, CAST(CEIL((x - radius + 126) / 4) AS BIGINT)), LEAST(63, CAST(FLOOR((x + radius + 126) / 4) AS BIGINT)))) AS col FROM
 (SELECT *, UNNEST(GENERATE_SERIES(GREATEST(0, CAST(CEIL((126 - y - radius) / 4) AS BIGINT)), LEAST(63, CAST(FLOOR((126 - y + radius) / 4) AS BIGINT)))) AS row FROM stroke))"""


@query("stroke_cells", f"SELECT layer, seq, COUNT(*) AS cells, CAST(FLOOR(SUM(SQRT(d2)) * 1000 + 0.5) AS BIGINT) AS reach FROM ({CELLS_OF}) WHERE d2 <= radius * radius GROUP BY layer, seq", "stroke")
def stroke_cells(v):
    return E.stroke_cells(v.view("stroke"), TILE).groupBy("layer", "seq").agg(F.count(F.lit(1)).alias("cells"), mm(F.sum(F.sqrt("d2"))).alias("reach"))


@query("apply_strokes", f"""WITH c AS (SELECT *, GREATEST(0, 1 - SQRT(d2) / radius) AS u FROM ({CELLS_OF}) WHERE d2 <= radius * radius), w AS (SELECT *, u * u * (3 - 2 * u) AS w FROM c),
 s AS (SELECT layer, row, col, seq, CASE tool WHEN 'Flatten' THEN 1 - w * LEAST(1, strength) ELSE 1e0 END AS a, CASE tool WHEN 'Flatten' THEN w * LEAST(1, strength) * target WHEN 'Raise' THEN w * strength ELSE -w * strength END AS b FROM w),
 f AS (SELECT layer, row, col, LIST_REDUCE(LIST(STRUCT_PACK(a := a, b := b) ORDER BY seq), lambda p, q: STRUCT_PACK(a := p.a * q.a, b := p.b * q.a + q.b)) AS t FROM s GROUP BY 1, 2, 3)
 SELECT d.layer, d.row, d.col, CAST(FLOOR((z * COALESCE(f.t.a, 1) + COALESCE(f.t.b, 0)) * 1000 + 0.5) AS BIGINT) AS z FROM dense d LEFT JOIN f USING (layer, row, col)""", "dense stroke")
def apply_strokes(v):
    return E.apply_strokes(v.view("dense"), v.view("stroke"), LAYER, TILE).withColumn("z", mm("z"))


def profile(v):
    """Heights along the derived ways: way_id, pos, x, y, z."""
    at = N.locate(v.way_node, v.position).where("x IS NOT NULL")
    return at.select("way_id", F.col("seq").alias("pos"), "x", "y", (F.lit(100.0) + F.col("node_id") % 41).alias("z"))


PROFILE = "SELECT way_id, seq AS pos, x, y, 1e2 + node_id % 41 AS z FROM located WHERE x IS NOT NULL"
LINE_W = kernel(0.6)


@query("smooth_along_line", f"""WITH p AS (SELECT way_id, pos, z, MIN(pos) OVER w AS lo, MAX(pos) OVER w AS hi FROM ({PROFILE.replace('WHERE x IS NOT NULL', '')}) WINDOW w AS (PARTITION BY way_id)),
 wt AS (SELECT * FROM (VALUES {", ".join(f"({i - len(LINE_W) // 2}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(LINE_W))}) AS t(k, w))
 SELECT p.way_id, p.pos, CAST(FLOOR(SUM(w * q.z) * 100 + 0.5) AS BIGINT) AS z FROM p CROSS JOIN wt JOIN p q ON q.way_id = p.way_id AND q.pos = GREATEST(p.lo, LEAST(p.hi, p.pos + k)) GROUP BY 1, 2""", "located")
def smooth_along_line(v):
    rows = v.way_node.select("way_id", F.col("seq").alias("pos"), (F.lit(100.0) + F.col("node_id") % 41).alias("z"))
    return E.smooth_along_line(rows, ["way_id"], 0.6).select("way_id", "pos", F.floor(F.col("z") * 100 + 0.5).alias("z"))


@query("limit_grade", f"""WITH RECURSIVE p AS (SELECT way_id, ROW_NUMBER() OVER w - 1 AS i, z, COALESCE(SQRT((x - LAG(x) OVER w) * (x - LAG(x) OVER w) + (y - LAG(y) OVER w) * (y - LAG(y) OVER w)) * 1 / 100, 0) AS step FROM
  ({PROFILE}) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
 f(way_id, i, z) AS (SELECT way_id, i, z FROM p WHERE i = 0 UNION ALL SELECT p.way_id, p.i, LEAST(GREATEST(p.z, f.z - p.step), f.z + p.step) FROM f JOIN p ON p.way_id = f.way_id AND p.i = f.i + 1),
 top AS (SELECT way_id, MAX(i) AS i FROM p GROUP BY 1),
 b(way_id, i, z) AS (SELECT f.way_id, f.i, f.z FROM f JOIN top USING (way_id, i) UNION ALL SELECT f.way_id, f.i, LEAST(GREATEST(f.z, b.z - p.step), b.z + p.step) FROM b JOIN f ON f.way_id = b.way_id AND f.i = b.i - 1 JOIN p ON p.way_id = b.way_id AND p.i = b.i)
 SELECT way_id, i AS pos, CAST(FLOOR(z * 1000 + 0.5) AS BIGINT) AS z FROM b""", "located")
def limit_grade(v):
    from geoloom.operators.ordered import block_row_number
    rows = block_row_number(profile(v), ["way_id"], ["pos"], F.floor(F.col("pos") / 4096), "rn")
    rows = rows.select("way_id", (F.col("rn") - 1).alias("pos"), "x", "y", "z")
    return E.limit_grade(rows, ["way_id"], 1.0).select("way_id", "pos", mm("z").alias("z"))


SEGS = "SELECT c_custkey AS id, CAST(FLOOR(c_custkey / 410) AS BIGINT) AS layer, (c_custkey * 37) % 260 - 13e1 AS x0, (c_custkey * 53) % 260 - 13e1 AS y0, (c_custkey * 41) % 260 - 13e1 AS x1, (c_custkey * 59) % 260 - 13e1 AS y1 FROM customer"


@query("corridor_cells", f"""WITH s AS ({SEGS}), g AS (SELECT *, c * 4e0 - 126 AS px, 126 - r * 4e0 AS py FROM s, LATERAL (SELECT UNNEST(GENERATE_SERIES(0, 63)) AS r), LATERAL (SELECT UNNEST(GENERATE_SERIES(0, 63)) AS c)),
 t AS (SELECT *, LEAST(1, GREATEST(0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM g WHERE (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) >= 1e-12),
 d AS (SELECT *, SQRT((x0 + t * (x1 - x0) - px) * (x0 + t * (x1 - x0) - px) + (y0 + t * (y1 - y0) - py) * (y0 + t * (y1 - y0) - py)) AS away FROM t),
 u AS (SELECT *, LEAST(1, GREATEST(0, (9 - away) / 6)) AS u FROM d)
 SELECT id, COUNT(*) AS cells, CAST(FLOOR(SUM(u * u * (3 - 2 * u)) * 1000 + 0.5) AS BIGINT) AS weight FROM u WHERE u > 0 GROUP BY id""")
def corridor_cells(v):
    rows = v.table("customer").selectExpr("c_custkey AS id", "(c_custkey * 37) % 260 - 13e1 AS x0", "(c_custkey * 53) % 260 - 13e1 AS y0", "(c_custkey * 41) % 260 - 13e1 AS x1",
                                          "(c_custkey * 59) % 260 - 13e1 AS y1", "6e0 AS width", "6e0 AS blend")
    return E.corridor_cells(rows, TILE).groupBy("id").agg(F.count(F.lit(1)).alias("cells"), mm(F.sum("weight")).alias("weight"))


@query("grade_corridors")
def grade_corridors(v):
    rows = v.table("customer").selectExpr("c_custkey AS line", "CAST(FLOOR(c_custkey / 410) AS BIGINT) AS layer", "(c_custkey * 37) % 240 - 12e1 AS ax", "(c_custkey * 53) % 240 - 12e1 AS ay")
    lines = rows.select("layer", "line", F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), (F.col("ax") + 9.0 * i).alias("x"), (F.col("ay") - 5.0 * i).alias("y")) for i in range(4)])))
    out = E.grade_corridors(v.view("dense"), lines, LAYER, TILE, width=6.0, blend=6.0, smoothing=8.0, percent=8.0)
    return out.withColumn("z", mm("z"))


QUAL = "SELECT o_custkey AS map_id, o_orderkey % 40 AS contributed, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1e0 + o_orderkey % 7 END AS rx, 1e0 + o_orderkey % 5 AS ry, CASE o_orderkey % 4 WHEN 0 THEN 'RH2000' WHEN 1 THEN 'EGM96' ELSE 'Unknown / unchanged' END AS datum FROM orders"


def quality_rows(v):
    return v.table("orders").selectExpr("o_custkey AS map_id", "o_orderkey % 40 AS contributed", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1e0 + o_orderkey % 7 END AS rx", "1e0 + o_orderkey % 5 AS ry",
                                        "CASE o_orderkey % 4 WHEN 0 THEN 'RH2000' WHEN 1 THEN 'EGM96' ELSE 'Unknown / unchanged' END AS datum")


@query("terrain_quality", f"""WITH q AS ({QUAL}), k AS (SELECT *, ((GREATEST(rx, ry) * 100 + rx * ry) * 100 + rx) * 100 + ry AS o FROM q WHERE contributed > 0)
 SELECT map_id, COUNT(*) AS sources, CAST(SUM(contributed) AS BIGINT) AS samples, CAST(ARG_MIN(rx, o) AS BIGINT) AS fx, CAST(ARG_MIN(ry, o) AS BIGINT) AS fy, CAST(ARG_MAX(rx, o) AS BIGINT) AS cx, CAST(ARG_MAX(ry, o) AS BIGINT) AS cy,
 CAST(MIN(rx) AS BIGINT) AS min_x, CAST(MAX(ry) FILTER (rx IS NOT NULL) AS BIGINT) AS max_y, CAST(COALESCE(SUM(contributed) FILTER (rx IS NULL), 0) AS BIGINT) AS unknown_samples,
 CAST(COALESCE(SUM(contributed) FILTER (rx > 4 OR (rx IS NOT NULL AND ry > 4)), 0) AS BIGINT) AS coarse_samples FROM k GROUP BY map_id""")
def terrain_quality(v):
    out = R.terrain_quality(quality_rows(v), ["map_id"], 4.0, 4.0, 4096)
    n = lambda c, a: F.col(c).cast("long").alias(a)
    return out.select("map_id", "sources", "samples", n("finest.rx", "fx"), n("finest.ry", "fy"), n("coarsest.rx", "cx"), n("coarsest.ry", "cy"), n("min_x", "min_x"), n("max_y", "max_y"),
                      "unknown_samples", "coarse_samples")


@query("datum_conflicts", f"WITH q AS ({QUAL}) SELECT map_id, COUNT(DISTINCT datum) AS datums FROM q WHERE contributed > 0 AND datum <> 'Unknown / unchanged' GROUP BY map_id HAVING COUNT(DISTINCT datum) > 1")
def datum_conflicts(v):
    return R.datum_conflicts(quality_rows(v), ["map_id"]).select("map_id", "datums")
