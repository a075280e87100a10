"""Queries for rings, faces and polygons."""

from pyspark.sql import functions as F

from geoloom.functions import faces as P
from geoloom.functions.geo import mm
from geoloom.operators import networks as N, polygons as G
from geoloom.plans.network_queries import D, MM, mm_sql
from geoloom.plans.registry import query
from geoloom.plans.views import SPEC

KEY = ["area_id"]
AREA_OF = "CASE shape WHEN 0 THEN w * h WHEN 1 THEN 3 * w * h ELSE 8 * w * h END"
# Rectangles that tile each shape, in units of w and h.
TILES = """(VALUES (0, 0, 0, 1, 1), (1, 0, 0, 2, 1), (1, 0, 1, 1, 2), (2, 0, 0, 3, 1), (2, 0, 1, 1, 2), (2, 2, 1, 3, 2), (2, 0, 2, 3, 3))
 AS tiles(shape, ax, ay, bx, by_)"""
ON_MAP_AREA = """GREATEST(0, LEAST(512, cx + bx * w) - GREATEST(-512, cx + ax * w)) * GREATEST(0, LEAST(512, cy + by_ * h) - GREATEST(-512, cy + ay * h))"""


def edges(v, keys=("area_id", "ring")):
    return G.ring_edges(v.rings, ["area_id", "map_id", "ring"])


@query("ring_edges", f"SELECT area_id, ring, idx, {mm_sql(x0='x0', y0='y0', x1='x1', y1='y1')} FROM ring_edge", "ring_edge")
def ring_edges(v):
    return edges(v).select("area_id", "ring", "idx", *[mm(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("signed_area", f"SELECT area_id, ring, {MM.format('SUM(x0 * y1 - x1 * y0) / 2', 'area')} FROM ring_edge GROUP BY area_id, ring", "ring_edge")
def signed_area(v):
    return G.ring_area(edges(v), ["area_id", "ring"]).select("area_id", "ring", mm("area").alias("area"))


def outlines(v):
    """Rings of the derived areas as faces: at most six vertices each."""
    rows = v.rings.groupBy("area_id", "ring").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y"))).alias("v"))
    return rows.select("area_id", "ring", F.transform("v", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).cast(P.FACE).alias("face"))


@query("point_in_ring", """SELECT area_id, ring, SUM(CASE WHEN (y0 > py) <> (y1 > py) AND px < x0 + (py - y0) * (x1 - x0) / (y1 - y0) THEN 1 ELSE 0 END) % 2 = 1 AS inside
 FROM ring_edge JOIN (SELECT area_id, cx + 15e-1 * w AS px, cy + 15e-1 * h AS py FROM area) USING (area_id) GROUP BY area_id, ring""", "ring_edge area")
def point_in_ring(v):
    centre = v.areas.select("area_id", (F.col("cx") + 1.5 * F.col("w")).alias("px"), (F.col("cy") + 1.5 * F.col("h")).alias("py"))
    return outlines(v).join(centre, "area_id").select("area_id", "ring", P.point_in_face("px", "py", "face").alias("inside"))


@query("triangulate", f"SELECT area_id, CASE shape WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 8 END AS triangles, {MM.format(AREA_OF, 'area')} FROM area", "area")
def triangulate(v):
    faces, _ = G.triangulate(edges(v), KEY)
    return faces.groupBy("area_id").agg(F.count(F.lit(1)).alias("triangles"), mm(F.sum(F.abs(P.signed_area("face")))).alias("area"))


@query("polygon_band_pairs", "SELECT area_id, CASE shape WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS pairs, CASE shape WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS bands FROM area", "area")
def polygon_band_pairs(v):
    pairs, _ = G.trapezoids(edges(v), KEY)
    return pairs.groupBy("area_id").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("band").alias("bands"))


@query("clip_polygons", f"SELECT area_id, {MM.format('SUM(' + ON_MAP_AREA + ')', 'area')} FROM area JOIN {TILES} USING (shape) GROUP BY area_id HAVING SUM({ON_MAP_AREA}) > 0", "area")
def clip_polygons(v):
    faces, _ = G.triangulate(edges(v), KEY)
    cut = G.clip_polygons(faces, SPEC.width, SPEC.height).where(F.size("face") >= 3)
    return cut.groupBy("area_id").agg(F.sum(F.abs(P.signed_area("face"))).alias("area")).where("area > 0").select("area_id", mm("area").alias("area"))


def _thin(v):
    p = v.position.where("x IS NOT NULL")
    far = P.face_of(P.point("x", "y"), P.point(F.col("x") + (F.col("node_id") % 3) * 1e-5, "y"), P.point(F.col("x") + 10, "y"),
                    P.point(F.col("x") + 10, F.col("y") + 10 * (F.col("node_id") % 2)), P.point("x", "y"))
    sliver = P.face_of(P.point("x", "y"), P.point(F.col("x") + 10, "y"), P.point(F.col("x") + 5, F.col("y") + 1e-5))
    return p.select("node_id", far.alias("face"), sliver.alias("sliver"))


@query("clean_face", "SELECT node_id, 2 + CASE WHEN CAST(x + (node_id % 3) * 1e-5 AS FLOAT) <> CAST(x AS FLOAT) THEN 1 ELSE 0 END "
       "+ CAST(node_id % 2 AS INT) AS corners FROM pos", "pos")
def clean_face(v):
    return _thin(v).select("node_id", F.size(P.clean_face("face")).alias("corners"))


@query("drop_collapsed_faces", "SELECT SUM(CASE WHEN CAST(y + 1e-5 AS FLOAT) = CAST(y AS FLOAT) THEN 1 ELSE 0 END) AS collapsed, "
       "SUM(CASE WHEN CAST(y + 1e-5 AS FLOAT) = CAST(y AS FLOAT) THEN 0 ELSE 1 END) AS kept FROM pos", "pos")
def drop_collapsed_faces(v):
    kept, lost = G.drop_collapsed_faces(_thin(v).select("node_id", F.col("sliver").alias("face")))
    return kept.agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(lost.limit(1)), F.lit(True))


@query("surface_faces", f"SELECT area_id, {MM.format('SUM(' + ON_MAP_AREA + ')', 'area')}, TRUE AS ccw FROM area JOIN {TILES} USING (shape) GROUP BY area_id HAVING SUM({ON_MAP_AREA}) > 1e-5", "area")
def surface_faces(v):
    from geoloom.operators.scenery import surface_faces as build
    faces, _, _ = build(edges(v), KEY, SPEC.width, SPEC.height)
    return faces.groupBy("area_id").agg(mm(F.sum(P.signed_area("face"))).alias("area"), F.bool_and(P.signed_area("face") > 0).alias("ccw"))


def member_ways(v):
    """Each ring as two ways, the second one reversed for odd areas; some second ways stop short."""
    half = F.floor(F.col("n") / 2)
    node = F.col("area_id") * 100 + F.col("ring") * 10 + F.col("idx")
    first = v.rings.where(F.col("idx") <= half).select("area_id", "ring", F.lit(0).alias("part"), F.col("idx").alias("seq"), node.alias("node_id"))
    step = F.when(F.col("idx") == 0, F.col("n")).otherwise(F.col("idx")) - half
    size = F.col("n") - half
    second = v.rings.where((F.col("idx") >= half) | (F.col("idx") == 0)).select(
        "area_id", "ring", F.lit(1).alias("part"), F.when(F.col("area_id") % 2 == 1, size - step).otherwise(step).alias("seq"), node.alias("node_id"), "idx")
    second = second.where(~((F.col("area_id") % 50 == 7) & (F.col("idx") == 0))).drop("idx")
    way = (F.col("area_id") * 10 + F.col("ring") * 2 + F.col("part")).alias("way_id")
    rows = first.unionByName(second).select("area_id", "ring", "part", way, F.col("seq").cast("long").alias("seq"), "node_id")
    members = rows.select("area_id", F.when(F.col("ring") == 0, "outer").otherwise("inner").alias("role"),
                          (F.col("ring") * 2 + F.col("part")).cast("long").alias("mseq"), "way_id").distinct()
    return members, rows.select("way_id", "seq", "node_id")


@query("assemble_rings", f"""SELECT area_id, 'ok' AS state, {MM.format(AREA_OF, 'area')} FROM area WHERE area_id % 50 <> 7
 UNION ALL SELECT area_id, 'open or ambiguous joint' AS state, NULL AS area FROM area WHERE area_id % 50 = 7""", "area")
def assemble_rings(v):
    members, way_node = member_ways(v)
    rings, issues = G.assemble_rings(members, way_node, ["area_id", "role"])
    spot = v.rings.select((F.col("area_id") * 100 + F.col("ring") * 10 + F.col("idx")).alias("node_id"), "x", "y")
    sides = G.ring_edges(rings.join(spot, "node_id"), ["area_id", "role", "ring"])
    area = G.ring_area(sides, ["area_id", "role", "ring"])
    net = area.groupBy("area_id").agg(F.sum(F.when(F.col("role") == "outer", F.abs("area")).otherwise(-F.abs("area"))).alias("a"))
    bad = issues.select("area_id", "reason").distinct()
    good = net.join(bad, "area_id", "left_anti").select("area_id", F.lit("ok").alias("state"), mm("a").alias("area"))
    return good.unionByName(bad.select("area_id", F.col("reason").alias("state"), F.lit(None).cast("long").alias("area")))


@query("validate_rings", """SELECT area_id, CASE shape WHEN 0 THEN 'self-intersecting' WHEN 1 THEN 'degenerate or repeated vertices'
 ELSE 'island outside its outer ring' END AS reason FROM area WHERE area_id % 10 = 3""", "area")
def validate_rings(v):
    odd = F.col("area_id") % 10 == 3
    shape = F.col("area_id") % 3
    rows = v.rings
    swap = F.when(odd & (shape == 0) & (F.col("idx") == 1), 2).when(odd & (shape == 0) & (F.col("idx") == 2), 1).otherwise(F.col("idx"))
    away = F.when(odd & (shape == 2) & (F.col("ring") == 1), 200.0).otherwise(0.0)
    moved = rows.select("area_id", "ring", swap.alias("idx"), "n", (F.col("x") + away).alias("x"), "y", (F.col("ring") > 0).alias("inner"))
    twin = moved.where("idx = 4").select("area_id", "ring", F.col("x").alias("tx"), F.col("y").alias("ty"))
    copy = (F.col("area_id") % 10 == 3) & (F.col("area_id") % 3 == 1) & (F.col("idx") == 5)
    moved = moved.join(twin, ["area_id", "ring"], "left").withColumns({"x": F.when(copy, F.col("tx")).otherwise(F.col("x")),
                                                                     "y": F.when(copy, F.col("ty")).otherwise(F.col("y"))}).drop("tx", "ty")
    sides = G.ring_edges(moved, ["area_id", "ring"]).join(moved.select("area_id", "ring", "n").distinct(), ["area_id", "ring"])
    return G.validate_rings(sides, moved, "area_id")


@query("split_triangles", """WITH RECURSIVE t(area_id, ax, ay, bx, by_, cx, cy, done) AS (
 SELECT area_id, cx, cy, cx + w, cy, cx, cy + h, FALSE FROM area UNION ALL
 SELECT area_id, CASE half WHEN 0 THEN px WHEN 1 THEN mx END, CASE half WHEN 0 THEN py WHEN 1 THEN my END, CASE half WHEN 0 THEN mx WHEN 1 THEN qx END,
  CASE half WHEN 0 THEN my WHEN 1 THEN qy END, rx, ry, FALSE FROM (SELECT *, (px + qx) / 2 AS mx, (py + qy) / 2 AS my FROM (
  SELECT area_id, CASE k WHEN 0 THEN ax WHEN 1 THEN bx ELSE cx END AS px, CASE k WHEN 0 THEN ay WHEN 1 THEN by_ ELSE cy END AS py,
   CASE k WHEN 0 THEN bx WHEN 1 THEN cx ELSE ax END AS qx, CASE k WHEN 0 THEN by_ WHEN 1 THEN cy ELSE ay END AS qy,
   CASE k WHEN 0 THEN cx WHEN 1 THEN ax ELSE bx END AS rx, CASE k WHEN 0 THEN cy WHEN 1 THEN ay ELSE by_ END AS ry FROM (
   SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS k FROM (SELECT *, SQRT((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) AS s0,
    SQRT((cx - bx) * (cx - bx) + (cy - by_) * (cy - by_)) AS s1, SQRT((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy)) AS s2 FROM t)
   WHERE GREATEST(s0, s1, s2) > 8))), (VALUES (0), (1)) AS halves(half))
 SELECT area_id, COUNT(*) AS pieces, CAST(FLOOR(SUM(ABS((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay)) / 2) * 1000 + 0.5) AS BIGINT) AS area FROM t
 WHERE GREATEST(SQRT((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)), SQRT((cx - bx) * (cx - bx) + (cy - by_) * (cy - by_)),
  SQRT((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy))) <= 8 GROUP BY area_id""", "area")
def split_triangles(v):
    x, y = F.col("cx"), F.col("cy")
    faces = v.areas.select("area_id", P.face_of(P.point(x, y), P.point(x + F.col("w"), y), P.point(x, y + F.col("h"))).alias("face"))
    out = G.split_triangles(faces, 8.0)
    return out.groupBy("area_id").agg(F.count(F.lit(1)).alias("pieces"), mm(F.sum(F.abs(P.signed_area("face")))).alias("area"))


@query("ribbon_faces", f"""SELECT way_id, SUM(CASE WHEN {D} >= 1e-6 THEN 1 ELSE 0 END) AS quads, SUM(CASE WHEN seq > 0 THEN 1 ELSE 0 END) AS joins,
 CAST(FLOOR(SUM({D} * 4) * 1000 + 0.5) AS BIGINT) AS area FROM seg WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND (seq > 0 OR {D} >= 1e-6) GROUP BY way_id""", "seg")
def ribbon_faces(v):
    seg = N.way_segments(v.way_node, v.position, v.references).where("x0 IS NOT NULL AND x1 IS NOT NULL").select(
        "way_id", F.col("seq").alias("idx"), "x0", "y0", "x1", "y1", F.lit(4.0).alias("width"), F.lit(9).alias("last"), F.lit(False).alias("closed"))
    quad = F.col("part") == "quad"
    return G.ribbon_faces(seg, ["way_id"]).groupBy("way_id").agg(
        F.count(F.when(quad, 1)).alias("quads"), F.count(F.when(~quad, 1)).alias("joins"),
        mm(F.coalesce(F.sum(F.when(quad, P.signed_area("face"))), F.lit(0.0))).alias("area"))


@query("footprint_box", f"""SELECT area_id, {mm_sql(px='cx + u * w / 2', py='cy + u * h / 2', width='u * GREATEST(w, h)', length='u * LEAST(w, h)',
 rotation="CASE WHEN w >= h THEN 0 WHEN shape = 1 THEN -PI() / 2 ELSE PI() / 2 END")} FROM (SELECT *, CAST(shape + 1 AS DOUBLE) AS u FROM area)""", "area")
def footprint_box(v):
    outer = edges(v).where("ring = 0")
    return G.footprint_box(outer, KEY).select("area_id", *[mm(c).alias(c) for c in ("px", "py", "width", "length", "rotation")])


@query("rect_fits_polygon", "SELECT area_id, CASE shape WHEN 0 THEN w >= 10 AND h >= 12 WHEN 1 THEN FALSE ELSE TRUE END AS fits FROM area", "area")
def rect_fits_polygon(v):
    centre = v.areas.selectExpr("area_id", "cx + (shape + 1) * w / 2 AS px", "cy + (shape + 1) * h / 2 AS py")
    rows = outlines(v).where("ring = 0").join(centre, "area_id")
    fits = G.box_in_face(F.col("px"), F.col("py"), F.lit(0.0), F.lit(10.0), F.lit(12.0), F.col("face"))
    return rows.select("area_id", fits.alias("fits"))


SPOT = ("SELECT event_id AS point, CAST(FLOOR(event_id * 15 / 10000) AS BIGINT) AS map_id, ((event_id * 7919) % 9001) / 10e0 - 450.05e0 AS x, "
        "((event_id * 104729) % 9007) / 10e0 - 450.03e0 AS y FROM events")


def spots(v):
    return v.table("events").selectExpr("event_id AS point", "CAST(FLOOR(event_id * 15 / 10000) AS BIGINT) AS map_id",
                                        "((event_id * 7919) % 9001) / 10D - 450.05D AS x", "((event_id * 104729) % 9007) / 10D - 450.03D AS y")


@query("points_in_polygons", f"""WITH spot AS ({SPOT}) SELECT point, area_id FROM spot s JOIN ring_edge e ON s.map_id = e.map_id AND (y0 > y) <> (y1 > y)
 AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) GROUP BY point, area_id HAVING COUNT(*) % 2 = 1""", "ring_edge")
def points_in_polygons(v):
    return G.points_in_polygons(spots(v), edges(v), ["map_id"], "area_id", "point").select("point", "area_id")


@query("holes_to_outers", "SELECT area_id, 0 AS outer_ring, 1 AS hole FROM area WHERE shape = 2", "area")
def holes_to_outers(v):
    holes = v.rings.where("ring > 0")
    found = G.holes_to_outers(holes, edges(v).where("ring = 0"), ["area_id"])
    return found.select("area_id", F.col("outer").alias("outer_ring"), "hole")
