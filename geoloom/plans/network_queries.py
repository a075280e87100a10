"""Queries for lines and networks."""

from pyspark.sql import functions as F

from geoloom.functions import tags as T
from geoloom.functions.geo import dist, mm
from geoloom.operators import networks as N
from geoloom.plans.registry import query
from geoloom.plans.views import SPEC
from geoloom.session import settle

W, H = SPEC.width, SPEC.height
MM = "CAST(FLOOR(({0}) * 1000 + 0.5) AS BIGINT) AS {1}"
D = "SQRT((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
CD = "SQRT((cx1 - cx0) * (cx1 - cx0) + (cy1 - cy0) * (cy1 - cy0))"


def mm_sql(**cols):
    return ", ".join(MM.format(e, a) for a, e in cols.items())


ROAD = "(COALESCE(t_highway, '') <> '' AND COALESCE(t_area, '') <> 'yes')"
KIND = f"CASE WHEN {ROAD} THEN 'road' WHEN t_railway IS NOT NULL THEN 'rail' END"


@query("network_length_by_class", f"""
SELECT kind, COUNT(*) AS segments, CAST(FLOOR(SUM({CD}) + 0.5) AS BIGINT) AS metres
FROM clip JOIN (SELECT way_id, {KIND} AS kind FROM way) USING (way_id) WHERE kind IS NOT NULL GROUP BY kind""", "clip way")
def network_length_by_class(v):
    kinds = v.ways.select("way_id", T.network_class("tags").alias("kind")).where("kind IS NOT NULL")
    cut = N.clip_segments(N.way_segments(v.way_node, v.position, v.references), W, H)
    return cut.join(kinds, "way_id").groupBy("kind").agg(
        F.count(F.lit(1)).alias("segments"),
        F.floor(F.sum(dist("cx0", "cy0", "cx1", "cy1")) + 0.5).cast("long").alias("metres"))


@query("way_segments", f"SELECT way_id, seq, node0, node1, {mm_sql(x0='x0', y0='y0', x1='x1', y1='y1')} FROM seg", "seg")
def way_segments(v):
    return N.way_segments(v.way_node, v.position, v.references).select("way_id", "seq", "node0", "node1", *[mm(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("segment_pairs", "SELECT way_id, seq, node_id AS node0, nxt AS node1 FROM (SELECT *, LEAD(node_id) OVER (PARTITION BY "
       "way_id ORDER BY seq) AS nxt FROM way_node) WHERE nxt IS NOT NULL", "way_node")
def segment_pairs(v):
    return N.pair_up(v.way_node, ["way_id"], "seq", ["node_id"], known=v.references).withColumnsRenamed({"node_id0": "node0", "node_id1": "node1"})


@query("missing_refs", "SELECT DISTINCT node_id FROM way_node WHERE node_id NOT IN (SELECT node_id FROM node)", "way_node node")
def missing_refs(v):
    return N.missing_refs(v.way_node, v.position, "node_id")


@query("clip_segments", f"SELECT way_id, seq, {mm_sql(low='low', high='high', cx0='cx0', cy0='cy0', cx1='cx1', cy1='cy1')} FROM clip", "clip")
def clip_segments(v):
    cut = N.clip_segments(N.way_segments(v.way_node, v.position, v.references), W, H)
    return cut.select("way_id", "seq", *[mm(c).alias(c) for c in ("low", "high", "cx0", "cy0", "cx1", "cy1")])


TRAVEL = f"COALESCE(SUM(COALESCE({D}, 0)) OVER (PARTITION BY way_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("travelled_length", f"SELECT way_id, seq, {MM.format(TRAVEL, 'travelled')} FROM seg", "seg")
def travelled_length(v):
    out = N.travelled_length(N.way_segments(v.way_node, v.position, v.references))
    return out.select("way_id", "seq", mm("travelled").alias("travelled"))


CHAINS = f"""WITH flagged AS (SELECT *, CASE WHEN pseq = seq - 1 AND SQRT((px - cx0) * (px - cx0) + (py - cy0) * (py - cy0)) <= 1e-5
  THEN 0 ELSE 1 END AS fresh FROM (SELECT *, LAG(seq) OVER w AS pseq, LAG(cx1) OVER w AS px, LAG(cy1) OVER w AS py
  FROM clip WHERE {CD} >= 1e-5 WINDOW w AS (PARTITION BY way_id ORDER BY seq))),
 chained AS (SELECT *, SUM(fresh) OVER (PARTITION BY way_id ORDER BY seq) AS chain FROM flagged) """


@query("chain_islands", CHAINS + "SELECT way_id, seq, CAST(chain AS BIGINT) AS chain FROM chained", "clip")
def chain_islands(v):
    cut = N.clip_segments(N.way_segments(v.way_node, v.position, v.references), W, H).where(dist("cx0", "cy0", "cx1", "cy1") >= 1e-5)
    return N.chain_islands(cut, ["way_id"]).select("way_id", "seq", "chain")


@query("line_chains", CHAINS + f"""SELECT way_id, CAST(chain AS BIGINT) AS chain, COUNT(*) + 1 AS vertices,
 CAST(FLOOR(SUM({CD}) * 1000 + 0.5) AS BIGINT) AS length FROM chained GROUP BY way_id, chain""", "clip")
def line_chains(v):
    cut = N.clip_segments(N.way_segments(v.way_node, v.position, v.references), W, H).where(dist("cx0", "cy0", "cx1", "cy1") >= 1e-5)
    lines = N.line_chains(cut, ["way_id"])
    steps = N.pair_up(lines, ["way_id", "chain"], "idx", ["x", "y"])
    return steps.groupBy("way_id", "chain").agg((F.count(F.lit(1)) + 1).alias("vertices"),
                                                mm(F.sum(dist("x0", "y0", "x1", "y1"))).alias("length"))


DIR = ("CASE WHEN LOWER(COALESCE(t_oneway, '')) IN ('-1', 'reverse') THEN -1 WHEN LOWER(COALESCE(t_oneway, '')) IN "
       "('yes', 'true', '1') THEN 1 WHEN LOWER(COALESCE(t_oneway, '')) IN ('no', 'false', '0') THEN 0 WHEN t_junction IN "
       "('roundabout', 'circular') OR t_highway = 'motorway' THEN 1 ELSE 0 END")
BRIDGE, TUNNEL = "(COALESCE(t_bridge, 'no') <> 'no')", "(COALESCE(t_tunnel, 'no') <> 'no')"
NETSEG = f"""WITH chosen AS (SELECT way_id, kind, {BRIDGE} AS bridge, {TUNNEL} AS tunnel, CASE WHEN kind = 'road' THEN {DIR} ELSE 0 END AS dir
  FROM (SELECT *, {KIND} AS kind FROM way) WHERE kind IS NOT NULL),
 sized AS (SELECT way_id, COUNT(*) AS n FROM way_node GROUP BY way_id),
 netseg AS (SELECT way_id, CASE WHEN dir = -1 THEN n - 2 - seq ELSE seq END AS seq, kind, bridge, tunnel, dir,
  CASE WHEN dir = -1 THEN node1 ELSE node0 END AS node0, CASE WHEN dir = -1 THEN node0 ELSE node1 END AS node1,
  CASE WHEN dir = -1 THEN x1 ELSE x0 END AS x0, CASE WHEN dir = -1 THEN y1 ELSE y0 END AS y0,
  CASE WHEN dir = -1 THEN x0 ELSE x1 END AS x1, CASE WHEN dir = -1 THEN y0 ELSE y1 END AS y1
  FROM seg JOIN chosen USING (way_id) JOIN sized USING (way_id)),
 netclip AS (SELECT *, x0 + low * (x1 - x0) AS cx0, y0 + low * (y1 - y0) AS cy0, x0 + high * (x1 - x0) AS cx1, y0 + high * (y1 - y0) AS cy1
  FROM (SELECT *, GREATEST(0e0, CASE WHEN x1 - x0 > 1e-12 THEN (-512 - x0) / (x1 - x0) WHEN x1 - x0 < -1e-12 THEN (512 - x0) / (x1 - x0) END,
   CASE WHEN y1 - y0 > 1e-12 THEN (-512 - y0) / (y1 - y0) WHEN y1 - y0 < -1e-12 THEN (512 - y0) / (y1 - y0) END) AS low,
   LEAST(1e0, CASE WHEN x1 - x0 > 1e-12 THEN (512 - x0) / (x1 - x0) WHEN x1 - x0 < -1e-12 THEN (-512 - x0) / (x1 - x0) END,
   CASE WHEN y1 - y0 > 1e-12 THEN (512 - y0) / (y1 - y0) WHEN y1 - y0 < -1e-12 THEN (-512 - y0) / (y1 - y0) END) AS high
   FROM netseg WHERE {D} >= 1e-5) WHERE low <= high AND (ABS(x1 - x0) >= 1e-12 OR ABS(x0) <= 512) AND (ABS(y1 - y0) >= 1e-12 OR ABS(y0) <= 512)),
 piece AS (SELECT *, CASE WHEN k = 0 AND low = 0 THEN CAST(node0 AS STRING) ELSE way_id || ':' || seq || ':' || k END AS a,
   CASE WHEN k = n - 1 AND high = 1 THEN CAST(node1 AS STRING) ELSE way_id || ':' || seq || ':' || (k + 1) END AS b
  FROM (SELECT *, UNNEST(GENERATE_SERIES(0, n - 1)) AS k FROM (SELECT *, GREATEST(1, CAST(CEIL({CD} / CASE WHEN kind = 'rail' THEN 120 ELSE 80 END) AS INT)) AS n
  FROM netclip))) """
NETVIEWS = "seg way way_node"


@query("subdivide_edges", NETSEG + f"""SELECT way_id, seq, CAST(k AS INT) AS k, kind, a AS node0, b AS node1,
 {mm_sql(x0='cx0 + (cx1 - cx0) * (k / n)', y0='cy0 + (cy1 - cy0) * (k / n)', x1='cx0 + (cx1 - cx0) * ((k + 1) / n)', y1='cy0 + (cy1 - cy0) * ((k + 1) / n)')}
 FROM piece""", NETVIEWS)
def subdivide_edges(v):
    pieces = N.subdivide_edges(N.network_segments(v.ways, v.way_node, v.position), W, H)
    at = lambda a, b, t: mm(F.col(a) + (F.col(b) - F.col(a)) * t)
    t0, t1 = F.col("k") / F.col("pieces"), (F.col("k") + 1) / F.col("pieces")
    return pieces.select("way_id", "seq", "k", "kind", F.col("start").alias("node0"), F.col("end").alias("node1"),
                         at("cx0", "cx1", t0).alias("x0"), at("cy0", "cy1", t0).alias("y0"),
                         at("cx0", "cx1", t1).alias("x1"), at("cy0", "cy1", t1).alias("y1"))


@query("signal_edges", NETSEG + """SELECT way_id, seq, CAST(k AS INT) AS k, node1, FALSE AS backward, 'signal' AS signal
 FROM piece JOIN (SELECT node_id AS node1 FROM node WHERE t_railway = 'signal') USING (node1)
 WHERE kind = 'rail' AND k = n - 1 AND high = 1""", NETVIEWS + " node")
def signal_edges(v):
    pieces = N.subdivide_edges(N.network_segments(v.ways, v.way_node, v.position), W, H)
    return N.signal_edges(pieces, v.nodes).select("way_id", "seq", "k", "node1", "backward", "signal")


GUIDES = NETSEG.rstrip() + f""", s AS (SELECT *, COALESCE({D}, 0) AS len FROM netseg WHERE bridge OR tunnel),
 ends AS (SELECT way_id, ARG_MIN(fx, place) AS fx, ARG_MIN(fy, place) AS fy, ARG_MAX(fx, place) AS lx, ARG_MAX(fy, place) AS ly FROM
  (SELECT way_id, 2 * seq AS place, x0 AS fx, y0 AS fy FROM s WHERE x0 IS NOT NULL UNION ALL
   SELECT way_id, 2 * seq + 1, x1, y1 FROM s WHERE x1 IS NOT NULL) GROUP BY way_id),
 tot AS (SELECT way_id, SUM(len) AS total FROM s GROUP BY way_id),
 tr AS (SELECT way_id, seq, len, COALESCE(SUM(len) OVER (PARTITION BY way_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS travelled FROM s),
 c AS (SELECT netclip.*, len, travelled, fx, fy, lx, ly, CASE WHEN total = 0 THEN 1 ELSE total END AS total, {CD} AS part
  FROM netclip JOIN tr USING (way_id, seq) JOIN ends USING (way_id) JOIN tot USING (way_id)),
 loose AS (SELECT * FROM c WHERE part >= 1e-5 AND NOT (ABS(fx) <= 512 AND ABS(fy) <= 512 AND ABS(lx) <= 512 AND ABS(ly) <= 512)),
 fl AS (SELECT *, CASE WHEN pseq = seq - 1 AND SQRT((px - cx0) * (px - cx0) + (py - cy0) * (py - cy0)) <= 1e-5 THEN 0 ELSE 1 END AS fresh
  FROM (SELECT *, LAG(seq) OVER w AS pseq, LAG(cx1) OVER w AS px, LAG(cy1) OVER w AS py FROM loose WINDOW w AS (PARTITION BY way_id ORDER BY seq))),
 ch AS (SELECT *, SUM(fresh) OVER (PARTITION BY way_id ORDER BY seq) AS chain FROM fl),
 g AS (SELECT way_id, seq, COALESCE(SUM(part) OVER (PARTITION BY way_id, chain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  SUM(part) OVER w AS span, FIRST_VALUE(cx0) OVER w AS sx, FIRST_VALUE(cy0) OVER w AS sy, LAST_VALUE(cx1) OVER w AS ex, LAST_VALUE(cy1) OVER w AS ey
  FROM ch WINDOW w AS (PARTITION BY way_id, chain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 guide AS (SELECT way_id, seq, COALESCE(sx, fx) AS gx0, COALESCE(sy, fy) AS gy0, COALESCE(ex, lx) AS gx1, COALESCE(ey, ly) AS gy1,
   COALESCE(off / span, (travelled + len * low) / total) AS g0, COALESCE((off + part) / span, (travelled + len * high) / total) AS g1 FROM c LEFT JOIN g USING (way_id, seq)) """


@query("structure_guides", GUIDES + f"SELECT way_id, seq, {mm_sql(gx0='gx0', gy0='gy0', gx1='gx1', gy1='gy1', g0='g0', g1='g1')} FROM guide", NETVIEWS)
def structure_guides(v):
    out = N.structure_guides(settle(N.network_segments(v.ways, v.way_node, v.position, structures=True)), W, H)
    return out.select("way_id", "seq", *[mm(c).alias(c) for c in ("gx0", "gy0", "gx1", "gy1", "g0", "g1")])


@query("densify_lines", f"""WITH steps AS (SELECT way_id, seq, x0, y0, x1, y1, GREATEST(1, CAST(CEIL({D} / 40) AS INT)) AS n FROM seg
  WHERE x0 IS NOT NULL AND x1 IS NOT NULL)
 SELECT way_id, COUNT(*) AS points, SUM(CAST(FLOOR((x0 + (x1 - x0) * (k / n)) * 1000 + 0.5) AS BIGINT)) AS sx FROM
 (SELECT *, UNNEST(GENERATE_SERIES(CASE WHEN seq = 0 THEN 0 ELSE 1 END, n)) AS k FROM steps) GROUP BY way_id""", "seg")
def densify_lines(v):
    vertices = N.locate(v.way_node, v.position).where("x IS NOT NULL").withColumnRenamed("seq", "idx")
    out = N.densify_lines(vertices, ["way_id"], 40.0)
    return out.groupBy("way_id").agg(F.count(F.lit(1)).alias("points"), F.sum(mm("x")).alias("sx"))


@query("join_corridors")
def join_corridors(v):
    edges = v.view("expected").select("edge_no", (F.col("node0") / 8).cast("long").alias("way_id"), "kind",
                                      F.lit(False).alias("bridge"), F.lit(False).alias("tunnel"), "node0", "node1")
    lines = N.join_corridors(edges)
    return lines.groupBy("way_id", "kind", "line").agg(F.count(F.lit(1)).alias("pieces"), F.max("pos").alias("last"),
                                                       F.sum(F.col("flipped").cast("long")).alias("flipped"))
