"""Queries for joins, aggregates, budgets, closures and catalogues."""

from pyspark.sql import functions as F

from geoloom.functions import faces as P, tags as T
from geoloom.functions.geo import mm
from geoloom.operators import graph, networks as N, quality as Q, scenery as S, spatial, water as W
from geoloom.plans.network_queries import mm_sql
from geoloom.plans.polygon_queries import edges as area_edges, spots
from geoloom.plans.registry import query
from geoloom.plans.scalar_queries import ITEM_SQL, OBJECT, POINT_KIND, WATER_KIND, items
from geoloom.plans.views import SPEC
from geoloom.sources import catalog as C, dataset as D, osm as O
from geoloom.spec import Bounds

# ---- entities and relations -------------------------------------------------------------------------------

MEMBERS = """SELECT c_custkey AS rel_id, 0 AS seq, 'way' AS type, c_custkey * 10 AS ref, 'outer' AS role FROM customer
 UNION ALL SELECT c_custkey, 1, 'way', c_custkey * 10 + 1, CASE WHEN c_custkey % 2 = 0 THEN 'inner' ELSE '' END FROM customer
 UNION ALL SELECT c_custkey, 2, 'relation', c_custkey + CASE WHEN c_custkey % 10 < 5 THEN 1 WHEN c_custkey % 20 = 5 THEN 0 ELSE 2000000000 END,
  CASE WHEN c_custkey % 3 = 0 THEN 'inner' ELSE 'outer' END FROM customer WHERE c_custkey % 10 < 3 OR c_custkey % 10 = 5"""


def members(v):
    way = lambda seq, role: v.table("customer").selectExpr("c_custkey AS rel_id", f"{seq} AS seq", "'way' AS type", f"c_custkey * 10 + {seq} AS ref", f"{role} AS role")
    nested = v.table("customer").where("c_custkey % 10 < 3 OR c_custkey % 10 = 5").selectExpr(
        "c_custkey AS rel_id", "2 AS seq", "'relation' AS type",
        "c_custkey + CASE WHEN c_custkey % 10 < 5 THEN 1 WHEN c_custkey % 20 = 5 THEN 0 ELSE 2000000000 END AS ref",
        "CASE WHEN c_custkey % 3 = 0 THEN 'inner' ELSE 'outer' END AS role")
    return way(0, "'outer'").unionByName(way(1, "CASE WHEN c_custkey % 2 = 0 THEN 'inner' ELSE '' END")).unionByName(nested)


@query("relation_members", f"WITH m AS ({MEMBERS}) SELECT rel_id, seq, t_highway AS highway FROM m JOIN way ON m.type = 'way' AND m.ref = way.way_id", "way")
def relation_members(v):
    m = members(v).where("type = 'way'")
    return m.join(v.ways.select(F.col("way_id").alias("ref"), T.tag("tags", "highway").alias("highway")), "ref").select("rel_id", "seq", "highway")


@query("covered_ways", f"WITH m AS ({MEMBERS}) SELECT way_id FROM way WHERE {WATER_KIND} IS NOT NULL AND way_id NOT IN (SELECT ref FROM m WHERE type = 'way')", "way")
def covered_ways(v):
    return S.uncovered_ways(v.ways.where(T.water_kind("tags").isNotNull()).select("way_id"), members(v))


TREE = f"""WITH RECURSIVE m AS ({MEMBERS}),
 d(root, type, ref, role, path) AS (
  SELECT rel_id, type, ref, CASE WHEN role = '' THEN 'outer' ELSE role END, [rel_id] FROM m
  UNION ALL SELECT d.root, m.type, m.ref, CASE WHEN d.role = 'outer' THEN CASE WHEN m.role = '' THEN 'outer' ELSE m.role END
   ELSE CASE WHEN m.role = 'inner' THEN 'outer' ELSE 'inner' END END, LIST_APPEND(d.path, d.ref)
  FROM d JOIN m ON d.type = 'relation' AND m.rel_id = d.ref WHERE NOT LIST_CONTAINS(d.path, d.ref)),
 bad AS (SELECT root, CASE WHEN type = 'way' THEN 'missing way' WHEN LIST_CONTAINS(path, ref) THEN 'cycle' ELSE 'missing relation' END AS reason FROM d
  WHERE (type = 'relation' AND (LIST_CONTAINS(path, ref) OR ref NOT IN (SELECT c_custkey FROM customer))) OR (type = 'way' AND ref NOT IN (SELECT o_orderkey FROM orders))) """


def _tree(v):
    relations = v.table("customer").select(F.col("c_custkey").alias("rel_id"))
    ways = v.table("orders").select(F.col("o_orderkey").alias("way_id"))
    return graph.multipolygon_tree(relations, members(v), relations, ways)


@query("resolve_multipolygons", TREE + "SELECT root, role, COUNT(*) AS ways, CAST(SUM(ref) AS BIGINT) AS total FROM d WHERE type = 'way' AND root NOT IN (SELECT root FROM bad) GROUP BY root, role")
def resolve_multipolygons(v):
    return _tree(v)[0].groupBy("root", "role").agg(F.count(F.lit(1)).alias("ways"), F.sum("way_id").alias("total"))


@query("multipolygon_tree", TREE + "SELECT DISTINCT root, reason FROM bad")
def multipolygon_tree(v):
    return _tree(v)[1].select("root", "reason")


@query("closed_way_areas", """WITH e AS (SELECT way_id, COUNT(*) AS n, ARG_MIN(node_id, seq) AS a, ARG_MAX(node_id, seq) AS b FROM way_node GROUP BY way_id)
 SELECT way_id, CASE t_natural WHEN 'wood' THEN 'forest' ELSE 'shrubs' END AS kind, n + 1 AS n FROM e JOIN way USING (way_id) WHERE n >= 3 AND t_natural IN ('wood', 'scrub')
 AND way_id NOT IN (SELECT c_custkey * 10 FROM customer)""", "way way_node")
def closed_way_areas(v):
    # Every way is closed by repeating its first node.
    ends = N.way_totals(v.way_node)
    closing = ends.select("way_id", F.col("n").alias("seq"), F.col("first_node").alias("node_id"))
    totals = N.way_totals(v.way_node.unionByName(closing))
    kind = F.when(T.same(T.tag("tags", "natural"), "wood"), "forest").when(T.same(T.tag("tags", "natural"), "scrub"), "shrubs")
    covered = members(v).where("type = 'way' AND seq = 0").select(F.col("ref").alias("way_id"))
    return S.closed_way_areas(v.ways, totals, kind, covered).select("way_id", "kind", "n")


SEEDS = "SELECT 'way' AS type, way_id AS id FROM way WHERE t_water = 'lake'"


@query("water_closure", f"""WITH RECURSIVE m AS ({MEMBERS}), up(type, id) AS ({SEEDS}
 UNION SELECT 'relation', m.rel_id FROM up JOIN m ON m.type = up.type AND m.ref = up.id) SELECT type, id FROM up WHERE type = 'relation'""", "way")
def water_closure(v):
    seeds = v.ways.where(T.same(T.tag("tags", "water"), "lake")).select(F.lit("way").alias("type"), F.col("way_id").alias("id"))
    return graph.water_closure(seeds, members(v)).where("type = 'relation'")


DOWN = f"""m AS ({MEMBERS}), child(type, id, ctype, cid) AS (SELECT 'way', way_id, 'node', node_id FROM way_node UNION ALL SELECT 'relation', rel_id, type, ref FROM m),
 known(type, id) AS (SELECT 'way', o_orderkey FROM orders UNION ALL SELECT 'node', p_partkey FROM part UNION ALL SELECT 'relation', c_custkey FROM customer)"""


def _children(v):
    return v.way_node.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.lit("node").alias("ctype"), F.col("node_id").alias("cid")).unionByName(
        members(v).select(F.lit("relation").alias("type"), F.col("rel_id").alias("id"), F.col("type").alias("ctype"), F.col("ref").alias("cid")))


def _known(v):
    one = lambda t, table, key: v.table(table).select(F.lit(t).alias("type"), F.col(key).alias("id"))
    return one("way", "orders", "o_orderkey").unionByName(one("node", "part", "p_partkey")).unionByName(one("relation", "customer", "c_custkey"))


@query("reachable_entities", f"""WITH RECURSIVE {DOWN}, seen(type, id) AS (SELECT 'relation', c_custkey FROM customer WHERE c_nationkey = 3
 UNION SELECT ctype, cid FROM seen JOIN child USING (type, id))
 SELECT type, id, (type, id) IN (SELECT (type, id) FROM known) AS present FROM seen""", "way_node")
def reachable_entities(v):
    seeds = v.table("customer").where("c_nationkey = 3").select(F.lit("relation").alias("type"), F.col("c_custkey").alias("id"))
    have, lost = graph.reachable_entities(seeds, _children(v), _known(v))
    return have.withColumn("present", F.lit(True)).unionByName(lost.withColumn("present", F.lit(False)))


@query("extract_area", f"""WITH RECURSIVE {DOWN}, inbox AS (SELECT node_id FROM node WHERE lat BETWEEN 2e-3 AND 4e-3 AND lon BETWEEN 2e-3 AND 4e-3),
 w AS (SELECT DISTINCT way_id FROM way_node WHERE node_id IN (SELECT node_id FROM inbox)),
 seed(type, id) AS (SELECT 'node', node_id FROM inbox UNION ALL SELECT 'way', way_id FROM w UNION ALL
  SELECT DISTINCT 'relation', rel_id FROM m WHERE type = 'way' AND ref IN (SELECT way_id FROM w)),
 seen(type, id) AS (SELECT * FROM seed UNION SELECT ctype, cid FROM seen JOIN child USING (type, id))
 SELECT type, (type, id) IN (SELECT (type, id) FROM known) AS present, COUNT(*) AS n, CAST(SUM(id) AS BIGINT) AS total FROM seen GROUP BY 1, 2""", "way_node node")
def extract_area(v):
    have, lost = O.extract_area(v.view("node"), v.way_node, members(v), _known(v), Bounds(0.002, 0.002, 0.004, 0.004))
    rows = have.withColumn("present", F.lit(True)).unionByName(lost.withColumn("present", F.lit(False)))
    return rows.groupBy("type", "present").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


@query("merge_osm_parts", """SELECT kind, id, CASE WHEN COUNT(DISTINCT v) > 1 THEN 'conflict' ELSE 'unique' END AS state FROM
 (SELECT CASE l_returnflag WHEN 'A' THEN 'node' WHEN 'N' THEN 'way' ELSE 'relation' END AS kind, l_partkey AS id, l_quantity = 50 AS v FROM lineitem) GROUP BY kind, id""")
def merge_osm_parts(v):
    rows = v.table("lineitem").select(
        F.col("l_linenumber").alias("part"), F.expr("CASE l_returnflag WHEN 'A' THEN 'node' WHEN 'N' THEN 'way' ELSE 'relation' END").alias("kind"),
        F.col("l_partkey").alias("id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("v"), (F.col("l_quantity") == 50).cast("string"), F.lit("a"), F.lit("1"))).otherwise(
            F.create_map(F.lit("a"), F.lit("1"), F.lit("v"), (F.col("l_quantity") == 50).cast("string"))).alias("attrs"),
        F.array(F.lit("n1"), F.lit("n2")).alias("children"))
    unique, conflicts = O.merge_osm_parts(rows)
    return unique.select("kind", "id", F.lit("unique").alias("state")).unionByName(conflicts.withColumn("state", F.lit("conflict")))


@query("validate_osm", """SELECT 'count' AS what, 'node' AS detail, COUNT(*) AS n FROM part UNION ALL SELECT 'count', 'way', COUNT(*) FROM orders
 UNION ALL SELECT 'count', 'relation', COUNT(*) FROM customer UNION ALL SELECT 'reject', 'bad coordinates', COUNT(*) FROM node WHERE lat * 9e3 > 90 OR lon * 2e4 > 180""", "node")
def validate_osm(v):
    nodes = v.view("node").select("node_id", (F.col("lat") * 9e3).alias("lat"), (F.col("lon") * 2e4).alias("lon"))
    counts, rejects = O.validate_osm(nodes, v.table("orders").select(F.col("o_orderkey").alias("way_id")), v.table("customer").select(F.col("c_custkey").alias("rel_id")))
    return counts.select(F.lit("count").alias("what"), F.col("kind").alias("detail"), "n").unionByName(
        rejects.groupBy(F.col("reason").alias("detail")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("reject").alias("what"), "detail", "n"))


@query("dataset_bounds", f"SELECT {mm_sql(south='1e6 * MIN(lat)', west='1e6 * MIN(lon)', north='1e6 * MAX(lat)', east='1e6 * MAX(lon)')}, TRUE AS inferred, FALSE AS conflict FROM node", "node")
def dataset_bounds(v):
    none = v.view("node").where(F.lit(False)).select(*[F.col("lat").alias(c) for c in ("south", "west", "north", "east")])
    out = O.dataset_bounds(none, v.view("node"))
    return out.select(*[mm(F.col(c) * 1e6).alias(c) for c in ("south", "west", "north", "east")], "inferred", "conflict")


@query("count_entities", "SELECT 'nodes' AS kind, COUNT(*) AS n FROM part UNION ALL SELECT 'ways', COUNT(*) FROM orders UNION ALL SELECT 'relations', COUNT(*) FROM customer")
def count_entities(v):
    return Q.count_entities(v.table("part"), v.table("orders"), v.table("customer"))


# ---- spatial and candidate joins --------------------------------------------------------------------------

@query("patch_overlaps", """SELECT a.map_id, a.id AS a, b.id AS b FROM patch a JOIN patch b ON a.map_id = b.map_id AND a.id < b.id
 AND ABS(a.x - b.x) < (a.length + b.length) / 2 + a.margin + b.margin AND ABS(a.y - b.y) < (a.width + b.width) / 2 + a.margin + b.margin""", "patch")
def patch_overlaps(v):
    return spatial.patch_overlaps(v.view("patch"), ["map_id"])


CORR = """SELECT CAST(FLOOR(event_id * 15 / 10000) AS BIGINT) AS map_id, ((event_id * 7919) % 9001) / 10e0 - 450.05e0 AS x0, ((event_id * 104729) % 9007) / 10e0 - 450.03e0 AS y0,
 ((event_id * 7919) % 9001) / 10e0 - 450.05e0 + event_id % 70 AS x1, ((event_id * 104729) % 9007) / 10e0 - 450.03e0 - event_id % 30 AS y1 FROM events"""


@query("reserve_corridors", f"""WITH corr AS ({CORR}) SELECT id FROM patch p WHERE NOT EXISTS (SELECT 1 FROM corr c WHERE c.map_id = p.map_id
 AND p.x <= GREATEST(x0, x1) + 2 AND p.x + 1 >= LEAST(x0, x1) - 2 AND p.y <= GREATEST(y0, y1) + 2 AND p.y + 1 >= LEAST(y0, y1) - 2)""", "patch")
def reserve_corridors(v):
    faces = v.view("patch").select("map_id", "id", F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + 1).alias("maxx"), (F.col("y") + 1).alias("maxy"))
    step = v.table("events").select(F.col("event_id").alias("point"), (F.col("event_id") % 70).alias("dx"), (F.col("event_id") % 30).alias("dy"))
    corr = spots(v).join(step, "point").select("map_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("dx")).alias("x1"), (F.col("y") - F.col("dy")).alias("y1"))
    return spatial.reserve_corridors(faces, corr, ["map_id"], "id", margin=2.0).select("id")


REQ = "SELECT n_nationkey AS request, n_nationkey % 5 AS rx0, n_nationkey / 10e0 AS ry0, n_nationkey % 5 + 3e-1 AS rx1, n_nationkey / 10e0 + 2e-1 AS ry1 FROM nation"


@query("bbox_overlap_join", f"WITH req AS ({REQ}) SELECT request, url, date, COUNT(*) AS n FROM asset JOIN req ON minx <= rx1 AND maxx >= rx0 AND miny <= ry1 AND maxy >= ry0 GROUP BY request, url, date", "asset")
def bbox_overlap_join(v):
    req = v.table("nation").selectExpr("n_nationkey AS request", "n_nationkey % 5 AS rx0", "n_nationkey / 10D AS ry0", "n_nationkey % 5 + 3e-1 AS rx1", "n_nationkey / 10D + 2e-1 AS ry1")
    return spatial.bbox_overlap_join(v.view("asset"), req, closed=True).groupBy("request", "url", "date").agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_places", """WITH RECURSIVE r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY rank) AS i FROM label),
 g(name, i, kept) AS (SELECT name, i, [STRUCT_PACK(rank := rank, x := x, y := y)] FROM r WHERE i = 1 UNION ALL
 SELECT g.name, r.i, CASE WHEN LEN(LIST_FILTER(g.kept, lambda k: SQRT((k.x - r.x) * (k.x - r.x) + (k.y - r.y) * (k.y - r.y)) < 300)) > 0 THEN g.kept
  ELSE LIST_APPEND(g.kept, STRUCT_PACK(rank := r.rank, x := r.x, y := r.y)) END FROM g JOIN r ON r.name = g.name AND r.i = g.i + 1)
 SELECT UNNEST(kept).rank AS rank FROM g JOIN (SELECT name, MAX(i) AS i FROM r GROUP BY name) USING (name, i)""", "label")
def dedupe_places(v):
    return S.dedupe_places(v.view("label")).select("rank")


OBJ_KIND = "CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'FURNITURE' THEN 'bench' WHEN 'MACHINERY' THEN 'industrial' WHEN 'HOUSEHOLD' THEN 'residential' ELSE 'lighthouse' END"
OBJ = f"""SELECT c_custkey AS item_id, {OBJ_KIND} AS kind, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 40) / 4e0 + 1 END AS height,
 CASE WHEN c_custkey % 4 <> 0 THEN 1e0 + c_custkey % 12 END AS width, CASE WHEN c_custkey % 4 <> 0 THEN 2e0 + c_custkey % 9 END AS length FROM customer"""
MATCH = f"""WITH obj AS ({OBJ}), pair AS (SELECT o.*, c.name, c.tier, c.height AS ch, swapped, CASE WHEN swapped THEN c.length ELSE c.width END AS w,
  CASE WHEN swapped THEN c.width ELSE c.length END AS l FROM obj o JOIN candidate c ON c.kind = o.kind OR (o.kind = 'building' AND c.kind IN ('residential', 'commercial', 'industrial')),
  (VALUES (FALSE), (TRUE)) AS s(swapped)),
 scored AS (SELECT *, ROUND(CASE WHEN width IS NULL THEN 1 ELSE ABS(LN(w / width)) + ABS(LN(l / length)) END
  + CASE WHEN height > 0 AND ch > 0 THEN 25e-2 * ABS(LN(ch / height)) ELSE 0 END, 9) AS score FROM pair WHERE width IS NULL OR (w <= width AND l <= length)),
 best AS (SELECT item_id, name, tier, swapped FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY tier, score, name, swapped) AS rn FROM scored) WHERE rn = 1) """


def objects(v):
    rows = v.table("customer").selectExpr(
        "c_custkey AS item_id", f"{OBJ_KIND} AS kind", "CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 40) / 4D + 1 END AS height",
        "CASE WHEN c_custkey % 4 <> 0 THEN 1e0 + c_custkey % 12 END AS width", "CASE WHEN c_custkey % 4 <> 0 THEN 2e0 + c_custkey % 9 END AS length")
    hw, hl = F.col("width") / 2, F.col("length") / 2
    box = P.face_of(P.point(-hw, -hl), P.point(hw, -hl), P.point(hw, hl), P.point(-hw, hl))
    return rows.withColumn("shape", F.when(F.col("width").isNotNull(), box))


def matches(v):
    models = v.view("candidate").withColumns({"cx": F.lit(0.0), "cy": F.lit(0.0)})
    return S.match_candidates(objects(v), models)


@query("match_candidates", MATCH + "SELECT obj.item_id, name, tier, swapped, name IS NULL AS unmatched FROM obj LEFT JOIN best USING (item_id)", "candidate")
def match_candidates(v):
    return matches(v).select("item_id", "name", "tier", "swapped", "unmatched")


@query("best_match", MATCH + "SELECT kind, MIN(name) AS name, COUNT(*) AS n FROM obj JOIN best USING (item_id) GROUP BY kind", "candidate")
def best_match(v):
    return matches(v).where("NOT unmatched").groupBy("kind").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))


@query("match_summary", MATCH + "SELECT COUNT(CASE WHEN tier = 0 THEN 1 END) AS tier0, COUNT(CASE WHEN tier > 0 THEN 1 END) AS tier1, COUNT(*) - COUNT(tier) AS unmatched FROM obj LEFT JOIN best USING (item_id)", "candidate")
def match_summary(v):
    return S.match_summary(matches(v), 20)[0]


@query("resolve_items", f"""SELECT i.item_id, CASE WHEN i.kind IS NULL OR m.o_orderkey IS NULL THEN 'own' ELSE 'model' || CAST(m.o_custkey AS STRING) END AS model FROM ({ITEM_SQL}) i
 LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') m ON m.o_orderkey = i.item_id WHERE i.kind IS NULL OR (m.o_orderkey IS NULL AND i.item_id % 2 = 0) OR m.o_orderstatus = 'F'""")
def resolve_items(v):
    saved = v.table("orders").where("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey AS item_id", "'model' || CAST(o_custkey AS STRING) AS m_model", "0D AS m_x", "0D AS m_y", "0D AS m_rotation", "o_orderstatus <> 'F' AS m_unmatched")
    rows = items(v).select("item_id", "kind", F.when(F.col("kind").isNull() | (F.col("item_id") % 2 == 0), "own").alias("model"),
                           F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("rotation"))
    return S.resolve_items(rows, saved).select("item_id", "model")


OBSERVED = """SELECT edge_no, CASE WHEN edge_no % 103 = 0 THEN node1 ELSE node0 END AS node0, CASE WHEN edge_no % 103 = 0 THEN node0 ELSE node1 END AS node1,
 CASE WHEN edge_no % 107 = 0 THEN 'wrong' ELSE cls END AS cls, kind FROM expected WHERE edge_no % 101 <> 0 UNION ALL SELECT edge_no, node0, node1, cls, kind FROM expected WHERE edge_no % 109 = 0"""


def observed(v):
    e = v.view("expected")
    turned = F.col("edge_no") % 103 == 0
    once = e.where("edge_no % 101 <> 0").select(
        "edge_no", F.when(turned, F.col("node1")).otherwise(F.col("node0")).alias("node0"), F.when(turned, F.col("node0")).otherwise(F.col("node1")).alias("node1"),
        F.when(F.col("edge_no") % 107 == 0, "wrong").otherwise(F.col("cls")).alias("cls"), "kind")
    return once.unionByName(e.where("edge_no % 109 = 0"))


RECON = f"""WITH obs AS ({OBSERVED}), cnt AS (SELECT LEAST(node0, node1) AS a, GREATEST(node0, node1) AS b, cls, kind, node0 <= node1 AS fwd, SUM(e) AS e, SUM(o) AS o FROM
  (SELECT node0, node1, cls, kind, 1 AS e, 0 AS o FROM expected UNION ALL SELECT node0, node1, cls, kind, 0, 1 FROM obs) GROUP BY ALL),
 lv AS (SELECT *, LEAST(e, o) AS exact FROM cnt),
 sm AS (SELECT a, b, cls, kind, SUM(e) AS e, SUM(o) AS o, SUM(exact) AS exact, SUM(CASE WHEN fwd THEN e - exact ELSE 0 END) AS fe, SUM(CASE WHEN fwd THEN 0 ELSE e - exact END) AS be,
  SUM(CASE WHEN fwd THEN o - exact ELSE 0 END) AS fo, SUM(CASE WHEN fwd THEN 0 ELSE o - exact END) AS bo FROM lv GROUP BY ALL),
 rv AS (SELECT *, LEAST(fe, bo) + LEAST(be, fo) AS rev FROM sm),
 pr AS (SELECT a, b, SUM(e) AS e, SUM(o) AS o, SUM(exact) AS exact, SUM(rev) AS rev, SUM(fe + be - rev) AS le, SUM(fo + bo - rev) AS lo FROM rv GROUP BY ALL)
 SELECT a, b, CAST(e AS BIGINT) AS expected, CAST(o AS BIGINT) AS observed, CAST(exact AS BIGINT) AS exact, CAST(rev AS BIGINT) AS reversed,
 CAST(LEAST(le, lo) AS BIGINT) AS wrong, CAST(le - LEAST(le, lo) AS BIGINT) AS missing, CAST(lo - LEAST(le, lo) AS BIGINT) AS extra FROM pr"""
query("reconcile_edges", RECON, "expected")(lambda v: Q.reconcile_edges(v.view("expected"), observed(v)))


@query("same_dataset", f"""WITH obs AS ({OBSERVED}) SELECT * FROM (SELECT edge_no, node0, node1, cls, kind, CAST(SUM(s) AS BIGINT) AS difference FROM
 (SELECT edge_no, node0, node1, cls, kind, 1 AS s FROM expected UNION ALL SELECT edge_no, node0, node1, cls, kind, -1 FROM obs) GROUP BY ALL) WHERE difference <> 0""", "expected")
def same_dataset(v):
    return D.same_dataset(v.view("expected"), observed(v))


@query("reconcile_items", """WITH e AS (SELECT o_custkey AS key, COUNT(*) AS expected FROM orders GROUP BY 1), f AS (SELECT o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 7 ELSE 0 END AS key,
 COUNT(*) AS found FROM orders GROUP BY 1) SELECT key, COALESCE(expected, 0) AS expected, COALESCE(found, 0) AS found, GREATEST(COALESCE(expected, 0) - COALESCE(found, 0), 0) AS missing,
 GREATEST(COALESCE(found, 0) - COALESCE(expected, 0), 0) AS extra FROM e FULL JOIN f USING (key) WHERE COALESCE(expected, 0) <> COALESCE(found, 0)""")
def reconcile_items(v):
    o = v.table("orders")
    return Q.reconcile_items(o.select(F.col("o_custkey").alias("key")), o.selectExpr("o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 7 ELSE 0 END AS key"))


@query("reconcile_positions", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 IN (3, 7)")
def reconcile_positions(v):
    o = v.table("orders")
    want = o.selectExpr("o_orderkey % 50 AS model", "o_orderkey * 1e0 AS x", "o_custkey * 1e0 AS y", "o_orderkey % 6 * 1e0 AS rotation", "o_orderkey AS id")
    seen = want.select("model", (F.col("x") + F.when(F.col("id") % 10 == 3, 0.011).otherwise(0.004)).alias("x"), (F.col("y") - 0.004).alias("y"),
                       (F.col("rotation") + F.when(F.col("id") % 10 == 7, 0.01).otherwise(6.283185307179586)).alias("rotation"))
    return Q.reconcile_positions(want, seen).select(F.floor(F.col("x")).alias("id"))


# ---- aggregates, budgets and checks ------------------------------------------------------------------------

INVENTORY = f"""WITH it AS ({ITEM_SQL}) SELECT 'category' AS level, category, NULL AS kind, COUNT(*) AS n FROM it GROUP BY category
 UNION ALL SELECT 'kind', NULL, kind, COUNT(*) FROM it WHERE kind IS NOT NULL GROUP BY kind
 UNION ALL SELECT 'bucket', category, kind, COUNT(*) FROM it WHERE NOT unmatched GROUP BY category, kind"""
query("feature_inventory", INVENTORY)(lambda v: Q.feature_inventory(items(v)))
query("selected_totals", f"SELECT COUNT(*) AS scenery FROM ({ITEM_SQL}) WHERE NOT unmatched AND category NOT IN ('buildings', 'surfaces') AND COALESCE(kind, '') <> 'tree'")(
    lambda v: Q.selected_totals(Q.feature_inventory(items(v)), {"buildings": False, "surfaces": False}, {"tree": False}))


@query("unavailable_tags", f"""SELECT tag, COUNT(*) AS n FROM (SELECT 'amenity=' || t_amenity AS tag, * FROM way WHERE t_amenity IS NOT NULL UNION ALL
 SELECT 'man_made=' || t_man_made, * FROM way WHERE t_man_made IS NOT NULL) WHERE ({OBJECT}) IS NULL GROUP BY tag""", "way")
def unavailable_tags(v):
    return S.unavailable_tags(v.ways)


@query("dataset_summary", """SELECT 'edges' AS metric, COUNT(*) AS n FROM expected UNION ALL SELECT 'road_segments', COUNT(*) FROM expected WHERE kind = 'STREET'
 UNION ALL SELECT 'rail_segments', COUNT(*) FROM expected WHERE kind = 'TRACK' UNION ALL SELECT 'bridge_segments', COUNT(*) FROM expected WHERE node0 % 9 = 0
 UNION ALL SELECT 'tunnel_segments', COUNT(*) FROM expected WHERE node1 % 9 = 0 UNION ALL SELECT 'scenery', COUNT(*) FROM orders UNION ALL SELECT 'labels', COUNT(*) FROM customer
 UNION ALL SELECT 'water_features', COUNT(*) FROM supplier UNION ALL SELECT 'lakes', COUNT(*) FROM supplier WHERE s_nationkey % 2 = 0""", "expected")
def dataset_summary(v):
    edges = v.view("expected").withColumns({"bridge": F.col("node0") % 9 == 0, "tunnel": F.col("node1") % 9 == 0})
    return Q.dataset_summary(edges, items(v), v.view("label"), v.table("supplier").select(F.when(F.col("s_nationkey") % 2 == 0, "lake").otherwise("shallow").alias("kind")))


@query("node_degree", """SELECT node, COUNT(*) AS degree, COUNT(CASE WHEN kind = 'STREET' THEN 1 END) AS streets, COUNT(CASE WHEN kind = 'TRACK' THEN 1 END) AS tracks
 FROM (SELECT node0 AS node, kind FROM expected UNION ALL SELECT node1, kind FROM expected) GROUP BY node""", "expected")
def node_degree(v):
    return Q.node_degree(v.view("expected"))


LINKS = "SELECT o_orderkey AS a, CAST(FLOOR(o_orderkey / 10) * 10 AS BIGINT) + o_custkey % 10 AS b FROM orders"


@query("connected_groups", f"""WITH RECURSIVE e AS ({LINKS}), link AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, label) AS (SELECT a, a FROM link UNION SELECT link.b, r.label FROM r JOIN link ON link.a = r.node)
 SELECT COUNT(DISTINCT label) AS groups FROM (SELECT node, MIN(label) AS label FROM r GROUP BY node)""")
def connected_groups(v):
    return graph.connected_groups(v.table("orders").selectExpr("o_orderkey AS a", "CAST(FLOOR(o_orderkey / 10) * 10 AS BIGINT) + o_custkey % 10 AS b"))


@query("import_progress", """SELECT section, expected, current FROM (SELECT o_orderpriority AS section, COUNT(*) AS expected, COUNT(CASE WHEN o_orderstatus <> 'P' OR o_orderpriority < '3' THEN 1 END) AS current
 FROM orders GROUP BY 1) WHERE expected <> current""")
def import_progress(v):
    o = v.table("orders").withColumnRenamed("o_orderpriority", "section")
    return Q.import_progress(o.groupBy("section").agg(F.count(F.lit(1)).alias("expected")),
                             o.where("o_orderstatus <> 'P' OR section < '3'").groupBy("section").agg(F.count(F.lit(1)).alias("current")))


@query("reconcile_towns", """SELECT c_custkey AS label_id, CASE WHEN c_custkey % 20 = 1 THEN 'missing town' WHEN c_custkey % 20 = 2 THEN 'recorded twice' WHEN c_custkey % 20 = 3 THEN 'wrong name'
 WHEN c_custkey % 20 = 4 THEN 'incomplete' WHEN c_custkey % 20 = 5 THEN 'wrong growth policy' END AS problem FROM customer WHERE c_custkey % 20 BETWEEN 1 AND 5""")
def reconcile_towns(v):
    labels = v.table("customer").select(F.col("c_custkey").alias("label_id"), F.col("c_name").alias("name"))
    k = F.col("label_id") % 20
    records = labels.where(k != 1).withColumn("_c", F.explode(F.when(k == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(
        "label_id", F.when(k == 3, "?").otherwise(F.col("name")).alias("name"), (k != 5).alias("growth"), F.lit(True).alias("allowed"), (k != 4).alias("complete"))
    return Q.reconcile_towns(labels, records)


@query("retry_safety", """SELECT c_custkey AS dataset_id, c_custkey % 6 = 0 AS safe, CASE c_custkey % 6 WHEN 0 THEN 'safe to replay' WHEN 1 THEN 'journal overlaps the range'
 WHEN 2 THEN 'entity journalled twice' WHEN 3 THEN 'range holds more than ground faces' WHEN 4 THEN 'no collapsed face in range' ELSE 'construction outside the journal' END AS reason FROM customer""")
def retry_safety(v):
    c = v.table("customer").select(F.col("c_custkey").alias("dataset_id"), (F.col("c_custkey") % 6).alias("k"))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    failed = c.select("dataset_id", F.lit(20).alias("first"), F.lit(24).alias("last"))
    entry = c.select("dataset_id", "k", many(2).alias("e"))
    journal = entry.select("dataset_id", (F.col("e") * 10).alias("first"), F.when(F.col("k") == 1, F.col("e") * 20).otherwise(F.col("e") * 10 + 9).alias("last"),
                           F.when(F.col("k") == 2, 1).otherwise(F.col("e")).alias("entity"))
    item = c.select("dataset_id", "k", many(30).alias("index")).select(
        "dataset_id", "index", (F.col("index") % 2 == 0).alias("selected"), (~((F.col("k") == 3) & (F.col("index") == 22))).alias("ground"),
        ((F.col("index") == 20) & (F.col("k") != 4)).alias("collapses"))
    built = entry.select("dataset_id", F.when((F.col("k") == 5) & (F.col("e") == 1), 99).when(F.col("k") == 2, 1).otherwise(F.col("e")).alias("entity"))
    return Q.retry_safety(failed, journal, item, built)


@query("check_map_dataset", """SELECT 'edge end does not exist' AS rule, COUNT(*) AS n FROM expected WHERE node1 >= (SELECT COUNT(*) FROM customer) UNION ALL
 SELECT 'edge ends coincide', COUNT(*) FROM expected JOIN label a ON a.rank = node0 JOIN label b ON b.rank = node1 WHERE SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 1e-8 HAVING COUNT(*) > 0 UNION ALL
 SELECT 'node off the map', COUNT(*) FROM label WHERE ABS(x) > 950 + 1e-5 OR ABS(y) > 950 + 1e-5 UNION ALL
 SELECT 'unknown resource', COUNT(*) FROM supplier WHERE s_nationkey = 24 UNION ALL
 SELECT 'face with under three corners', COUNT(*) FROM supplier WHERE s_suppkey % 5 < 3 UNION ALL
 SELECT 'water face is no triangle', COUNT(*) FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 <> 3 UNION ALL
 SELECT 'town name used twice', COUNT(*) FROM (SELECT name FROM label WHERE rank % 2 = 0 GROUP BY name HAVING COUNT(*) > 1)""", "expected label")
def check_map_dataset(v):
    nodes = v.view("label").select(F.col("rank").alias("node_id"), "x", "y")
    faces = v.table("supplier").selectExpr("s_suppkey AS item_id", "CASE WHEN s_suppkey % 2 = 0 THEN 'waterways' ELSE 'surfaces' END AS category", "s_nationkey AS cls",
                                           "s_suppkey % 5 AS corners", "0D AS x", "0D AS y")
    known = v.table("nation").where("n_nationkey < 24").select(F.col("n_nationkey").alias("cls"))
    labels = v.view("label").select(F.col("rank").alias("label_id"), "name", (F.col("rank") % 2 == 0).alias("town"))
    edges = v.view("expected").withColumnRenamed("edge_no", "edge_id")
    return Q.check_map_dataset(edges, nodes, faces, labels, known, 1900.0, 1900.0).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("check_manifest", "SELECT o_orderpriority AS field, COUNT(*) AS stored, COUNT(*) - 1 AS actual FROM orders WHERE o_orderpriority < '2' GROUP BY 1")
def check_manifest(v):
    n = v.table("orders").groupBy(F.col("o_orderpriority").alias("field")).agg(F.count(F.lit(1)).alias("n"))
    return Q.check_manifest(n.select("field", F.col("n").alias("stored")), n.select("field", F.when(F.col("field") < "2", F.col("n") - 1).otherwise(F.col("n")).alias("actual")))


def _edges_sql():
    """The pair audit of ``reconcile_edges``, added up."""
    from geoloom.plans.registry import ORACLES
    return f"SELECT CAST(SUM(reversed + wrong + missing + extra) AS BIGINT) FROM ({ORACLES['reconcile_edges']}) audit"


@query("reconcile_import", f"""WITH obs AS ({OBSERVED}), dg AS (SELECT node, COUNT(*) AS n FROM (SELECT node0 AS node FROM expected UNION ALL SELECT node1 FROM expected) GROUP BY 1),
 od AS (SELECT node, COUNT(*) AS n FROM (SELECT node0 AS node FROM obs UNION ALL SELECT node1 FROM obs) GROUP BY 1)
 SELECT 'nodes' AS metric, (SELECT COUNT(*) FROM label) AS expected, (SELECT COUNT(*) FROM label WHERE rank % 40 <> 0) AS current, (SELECT COUNT(*) FROM label WHERE rank % 40 IN (0, 1)) AS problems
 UNION ALL SELECT 'edges', (SELECT COUNT(*) FROM expected), (SELECT COUNT(*) FROM obs), ({_edges_sql()})
 UNION ALL SELECT 'items', (SELECT COUNT(*) FROM customer), (SELECT COUNT(*) FROM customer WHERE c_custkey % 30 <> 0), (SELECT COUNT(*) FROM customer WHERE c_custkey % 30 = 0)
 UNION ALL SELECT 'labels', (SELECT COUNT(*) FROM label), (SELECT COUNT(*) FROM label WHERE rank % 50 <> 0), (SELECT COUNT(*) FROM label WHERE rank % 50 = 0)
 UNION ALL SELECT 'counters', (SELECT COUNT(DISTINCT o_orderpriority) FROM orders), (SELECT COUNT(DISTINCT o_orderpriority) FROM orders), (SELECT COUNT(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority < '2')
 UNION ALL SELECT 'degrees', 2 * (SELECT COUNT(*) FROM expected), 2 * (SELECT COUNT(*) FROM obs), (SELECT COUNT(*) FROM dg FULL JOIN od USING (node) WHERE dg.n IS DISTINCT FROM od.n)""", "expected label")
def reconcile_import(v):
    nodes = v.view("label").select(F.col("rank").alias("node_id"), "x", "y", F.lit(5.0).alias("z"))
    seen = nodes.where("node_id % 40 <> 0").withColumn("z", F.when(F.col("node_id") % 40 == 1, 5.5).otherwise(5.005))
    item = v.table("customer").select(F.col("c_name").alias("key"), "c_custkey")
    label = v.view("label").select(F.col("name").alias("key"))
    count = v.table("orders").groupBy(F.col("o_orderpriority").alias("field")).agg(F.count(F.lit(1)).alias("stored"))
    actual = count.select("field", F.when(F.col("field") < "2", F.col("stored") - 1).otherwise(F.col("stored")).alias("actual"))
    out = Q.reconcile_import(v.view("expected"), observed(v), item, item.where("c_custkey % 30 <> 0"), nodes, seen,
                             labels=(label, v.view("label").where("rank % 50 <> 0").select(F.col("name").alias("key"))), counters=(count, actual))
    return out


@query("scatter_points", """WITH bx AS (SELECT area_id, GREATEST(-512e0, MIN(x)) AS minx, LEAST(512e0, MAX(x)) AS maxx, GREATEST(-512e0, MIN(y)) AS miny, LEAST(512e0, MAX(y)) AS maxy FROM rings GROUP BY area_id),
 gr AS (SELECT *, UNNEST(GENERATE_SERIES(0, CAST(CEIL((maxx - minx) / 6 - 5e-1) AS INT) - 1)) AS i FROM (SELECT *, UNNEST(GENERATE_SERIES(0, CAST(CEIL((maxy - miny) / 6 - 5e-1) AS INT) - 1)) AS j FROM bx)),
 h AS (SELECT *, '7|' || area_id || '|' || i || '|' || j || '|' AS base FROM gr),
 pt AS (SELECT area_id, i, j, minx + 6 * (i + 5e-1) + (CAST('0x' || SUBSTR(MD5(base || 'x'), 1, 8) AS BIGINT) / 4294967296e0 * 2 - 1) * 6 * 3e-1 AS px,
  miny + 6 * (j + 5e-1) + (CAST('0x' || SUBSTR(MD5(base || 'y'), 1, 8) AS BIGINT) / 4294967296e0 * 2 - 1) * 6 * 3e-1 AS py,
  CAST(FLOOR(CAST('0x' || SUBSTR(MD5(base || 's'), 1, 8) AS BIGINT) / 4294967296e0 * 3) AS INT) AS s FROM h)
 SELECT area_id, i, j, CAST(FLOOR(ANY_VALUE(px) * 1000 + 0.5) AS BIGINT) AS x, CAST(FLOOR(ANY_VALUE(py) * 1000 + 0.5) AS BIGINT) AS y, CASE ANY_VALUE(s) WHEN 0 THEN 'Oak' WHEN 1 THEN 'Linden' ELSE 'Maple' END AS species
 FROM pt JOIN ring_edge USING (area_id) WHERE ABS(px) <= 512 AND ABS(py) <= 512 AND (y0 > py) <> (y1 > py) AND px < x0 + (py - y0) * (x1 - x0) / (y1 - y0) GROUP BY area_id, i, j HAVING COUNT(*) % 2 = 1""", "ring_edge")
def scatter_points(v):
    areas = v.areas.select("area_id", F.lit(6.0).alias("step"), F.array(F.lit("Oak"), F.lit("Linden"), F.lit("Maple")).alias("species"))
    out = S.scatter_points(area_edges(v), areas, "area_id", SPEC.width, SPEC.height, 0.3, "7")
    return out.select("area_id", "i", "j", mm("x").alias("x"), mm("y").alias("y"), "species")


@query("cap_items", "SELECT o_orderkey AS item_id FROM orders ORDER BY o_custkey, o_orderkey LIMIT 700")
def cap_items(v):
    return S.cap_items(v.table("orders").select(F.col("o_orderkey").alias("item_id"), "o_custkey"), ["o_custkey", "item_id"], 700)[0].select("item_id")


@query("face_budget", """WITH RECURSIVE f AS (SELECT o_orderkey AS feature, CAST(FLOOR(o_totalprice / 100) AS BIGINT) AS faces FROM orders),
 g(feature, taken, left_over) AS (SELECT CAST(-1 AS BIGINT), FALSE, CAST(30000 AS BIGINT) UNION ALL SELECT f.feature, f.faces <= g.left_over, g.left_over - CASE WHEN f.faces <= g.left_over THEN f.faces ELSE 0 END
 FROM g JOIN f ON f.feature = g.feature + 1) SELECT feature, faces, taken AS accepted FROM g JOIN f USING (feature)""")
def face_budget(v):
    rows = v.table("orders").select(F.col("o_orderkey").alias("feature"), F.col("o_orderkey").alias("ord"), F.floor(F.col("o_totalprice") / 100).alias("faces"))
    return W.face_budget(rows, 30_000)


@query("place_objects", f"SELECT node_id, kind, CASE kind WHEN 'tree' THEN 'vegetation' ELSE 'objects' END AS category FROM (SELECT node_id, {POINT_KIND} AS kind FROM node) JOIN pos USING (node_id) "
       "WHERE kind IS NOT NULL AND ABS(x) <= 512 AND ABS(y) <= 512", "node pos")
def place_objects(v):
    return S.place_objects(v.nodes, v.position, SPEC.width, SPEC.height).select("node_id", "kind", "category")


@query("map_buildings", f"""SELECT area_id, kind, CASE WHEN building THEN 'buildings' ELSE 'mappedObjects' END AS category, {mm_sql(width='(shape + 1) * GREATEST(w, h)', length='(shape + 1) * LEAST(w, h)')}
 FROM (SELECT way_id AS area_id, {OBJECT} AS kind, COALESCE(t_building, 'no') <> 'no' AS building FROM way) JOIN area USING (area_id)
 WHERE kind IS NOT NULL AND ABS(cx + (shape + 1) * w) <= 512 AND ABS(cy + (shape + 1) * h) <= 512""", "way area")
def map_buildings(v):
    tagged = v.ways.select(F.col("way_id").alias("area_id"), "tags")
    out = S.map_buildings(tagged, area_edges(v).where("ring = 0"), ["area_id"], SPEC.width, SPEC.height)
    return out.where("kind IS NOT NULL").select("area_id", "kind", "category", mm("width").alias("width"), mm("length").alias("length"))


@query("union_features", f"SELECT 0 AS stage, 'points' AS branch, COUNT(*) AS n FROM node WHERE {POINT_KIND} IS NOT NULL UNION ALL SELECT 1, 'items', COUNT(*) FROM orders UNION ALL SELECT 2, 'labels', COUNT(*) FROM customer", "node")
def union_features(v):
    points = v.nodes.select(F.col("node_id").alias("item_id"), T.point_object_kind("tags").alias("kind")).where("kind IS NOT NULL")
    return S.union_features(points=points, items=items(v), labels=v.view("label")).groupBy("stage", "branch").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_issues", "SELECT l_shipdate AS code, l_suppkey AS entity, MIN(l_orderkey) AS seq FROM (SELECT CAST(CAST(l_shipdate AS DATE) AS STRING) AS l_shipdate, l_suppkey, l_orderkey FROM lineitem) GROUP BY 1, 2")
def distinct_issues(v):
    return C.distinct_issues(v.table("lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("code"), F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("seq")))


@query("dedupe_paths", "SELECT o_custkey AS path, MIN(o_orderkey) AS pos FROM orders GROUP BY 1")
def dedupe_paths(v):
    return C.dedupe_paths(v.table("orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("pos")), "path", "pos")


@query("head_with_omitted", """SELECT o_custkey, o_orderkey, place, GREATEST(n - 5, 0) AS omitted FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place,
 COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE place <= 5""")
def head_with_omitted(v):
    return D.head_with_omitted(v.table("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 5)


@query("preview_slice", """SELECT 'edges' AS part, CAST(SUM(edge_no) AS BIGINT) AS total FROM (SELECT edge_no FROM expected ORDER BY edge_no LIMIT 2000) UNION ALL
 SELECT 'nodes', CAST(SUM(rank) AS BIGINT) FROM label WHERE rank IN (SELECT node0 FROM (SELECT * FROM expected ORDER BY edge_no LIMIT 2000)) OR rank IN (SELECT node1 FROM (SELECT * FROM expected ORDER BY edge_no LIMIT 2000)) UNION ALL
 SELECT 'scenery', CAST(SUM(o_orderkey) AS BIGINT) FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 1200) UNION ALL SELECT 'labels', CAST(SUM(rank) AS BIGINT) FROM (SELECT rank FROM label ORDER BY 1 LIMIT 100) UNION ALL SELECT 'limited', 1""", "expected label")
def preview_slice(v):
    nodes = v.view("label").select(F.col("rank").alias("node_id"))
    parts = D.preview_slice(v.view("expected"), nodes, items(v), v.view("label").select(F.col("rank").alias("label_id")), (2000, 1200, 100))
    total = lambda df, name, c: df.agg(F.sum(c).alias("total")).select(F.lit(name).alias("part"), "total")
    out = total(parts[0], "edges", "edge_no")
    for df, name, c in ((parts[1], "nodes", "node_id"), (parts[2], "scenery", "item_id"), (parts[3], "labels", "label_id")):
        out = out.unionByName(total(df, name, c))
    return out.unionByName(parts[4].select(F.lit("limited").alias("part"), F.col("limited").cast("long").alias("total")))


FRAMED = " || ".join(f"COALESCE(LENGTH(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("col", "layer", "row", "z"))
FRAMES = "".join(f"{len(c)}:{c}{len(k)}:{k}" for c, k in (("col", "bigint"), ("layer", "bigint"), ("row", "bigint"), ("z", "double")))


@query("fingerprint", f"""WITH h AS (SELECT layer, sha256('{FRAMES}' || {FRAMED}) AS h FROM cell),
 s AS (SELECT layer, SUM(CAST('0x' || SUBSTR(h, 1, 12) AS BIGINT)) AS a, SUM(CAST('0x' || SUBSTR(h, 13, 12) AS BIGINT)) AS b, SUM(CAST('0x' || SUBSTR(h, 25, 12) AS BIGINT)) AS c,
  SUM(CAST('0x' || SUBSTR(h, 37, 12) AS BIGINT)) AS d, COUNT(*) AS n FROM h GROUP BY layer)
 SELECT layer, SUBSTR(sha256(concat_ws('|', CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR), CAST(d AS VARCHAR), CAST(n AS VARCHAR))), 1, 24) AS fingerprint, n AS rows FROM s""", "cell")
def fingerprint(v):
    return D.fingerprint(v.view("cell"), ["layer"])


@query("prepare_water")
def prepare_water(v):
    """All derived ways as water on a map an eighth of the usual size, so that streams are tens of metres long."""
    relations = v.ways.select(F.col("way_id").alias("rel_id"), "tags")
    position = v.position.select("node_id", (F.col("x") / 8).alias("x"), (F.col("y") / 8).alias("y"))
    roads = v.ways.where(T.network_class("tags").isNotNull()).select("way_id")
    corridors = N.way_segments(v.way_node.join(roads, "way_id", "left_semi"), position, v.references).where("x0 IS NOT NULL AND x1 IS NOT NULL").select("x0", "y0", "x1", "y1")
    features, faces = W.prepare_water(v.nodes, v.ways, relations, members(v), v.way_node, position, corridors, SPEC.width / 8, SPEC.height / 8)
    kept = faces.groupBy("fid").agg(F.count(F.lit(1)).alias("kept"), F.sum(mm(P.signed_area("face"))).alias("area"), F.sum(mm("depth")).alias("depth"))
    rows = features.withColumn("fid", F.concat_ws(":", "type", F.col("id").cast("string"))).join(kept, "fid", "left")
    return rows.groupBy("type", "kind", "status", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("faces").alias("faces"), F.sum("reserved").alias("reserved"), F.count("name").alias("named"), F.count("ele_raw").alias("heights"),
        F.count("width_source").alias("sized"), F.sum(mm("width")).alias("width"), F.sum("kept").alias("kept"), F.sum("area").alias("area"), F.sum("depth").alias("depth"))


# ---- catalogues -------------------------------------------------------------------------------------------

BOX = (0.0, 0.0, 3.0, 3.0)
INGEST = """WITH u AS (SELECT catalog_id, url, MAX(date) AS date FROM asset WHERE url LIKE '%.tif' AND minx < 3 AND maxx > 0 AND miny < 3 AND maxy > 0 GROUP BY 1, 2),
 k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY catalog_id ORDER BY date DESC, url) AS rank, COUNT(*) OVER (PARTITION BY catalog_id) > 12 AS truncated FROM u),
 kept AS (SELECT * FROM k WHERE rank <= 12) """


def pages(v):
    """Landed catalogue pages, one feature each, as JSON text."""
    a = v.view("asset")
    feature = F.struct(F.lit("dtm").alias("collection"), F.array("minx", "miny", "maxx", "maxy").alias("bbox"), F.struct(F.col("date").alias("datetime")).alias("properties"),
                       F.create_map(F.lit("data"), F.struct(F.col("url").alias("href"), F.col("bytes").alias("file:size"))).alias("assets"))
    return a.select("catalog_id", F.to_json(F.struct(F.array(feature).alias("features"))).alias("body"))


def ingested(v):
    return C.ingest_catalog(C.read_pages(pages(v), "body", "catalog_id"), BOX, 12)


@query("ingest_catalog", INGEST + "SELECT catalog_id, url, date, rank, truncated FROM kept", "asset")
def ingest_catalog(v):
    return ingested(v).select("catalog_id", "url", "date", "rank", "truncated")


@query("catalog_access", INGEST + """SELECT catalog_id, COUNT(*) AS tiles, COUNT(*) > 9 OR BOOL_OR(truncated) AS blocked, CASE WHEN BOOL_OR(truncated) THEN 'narrow the map' WHEN COUNT(*) > 9
 THEN 'raise the tile limit' ELSE 'within the limit' END AS hint FROM kept GROUP BY catalog_id""", "asset")
def catalog_access(v):
    return C.catalog_access(ingested(v), 9)


@query("newest_assets", "SELECT catalog_id, url, date, ROW_NUMBER() OVER (PARTITION BY catalog_id ORDER BY date DESC, url) AS place FROM asset", "asset")
def newest_assets(v):
    return C.newest_assets(v.view("asset")).select("catalog_id", "url", "date", "place")


@query("select_assets", INGEST + """, sized AS (SELECT catalog_id, COUNT(*) AS n FROM kept GROUP BY 1), one AS (SELECT catalog_id, url, ANY_VALUE(minx) AS minx, ANY_VALUE(miny) AS miny FROM asset GROUP BY 1, 2)
 SELECT k.catalog_id, k.url, CASE WHEN truncated THEN 'incomplete search' WHEN n > 9 THEN 'too many tiles' END AS refused FROM kept k JOIN sized USING (catalog_id) JOIN one USING (catalog_id, url)
 WHERE minx < 2 AND minx + 5e-1 > 1 AND miny < 2 AND miny + 5e-1 > 1""", "asset")
def select_assets(v):
    return C.select_assets(ingested(v), (1.0, 1.0, 2.0, 2.0), 9, 10 ** 12).select("catalog_id", "url", "refused")


@query("route_requests", """SELECT id, catalog FROM (SELECT o_orderkey AS id, o_custkey % 300 - 15e1 AS lon, o_custkey % 80 - 5e0 AS lat FROM orders), (VALUES ('nordic'), ('america'), ('worldwide')) AS c(catalog)
 WHERE catalog = 'worldwide' OR (catalog = 'nordic' AND lon < 25 AND lon + 1 > 10 AND lat < 70 AND lat + 1 > 55) OR (catalog = 'america' AND lon < -65 AND lon + 1 > -180 AND lat < 75 AND lat + 1 > 17)""")
def route_requests(v):
    boxes = v.table("orders").selectExpr("o_orderkey AS id", "o_custkey % 300 - 15e1 AS minx", "o_custkey % 80 - 5e0 AS miny").withColumns(
        {"maxx": F.col("minx") + 1, "maxy": F.col("miny") + 1})
    return C.route_requests(boxes, True).select("id", "catalog")


@query("normalise_extent", "SELECT path, CASE WHEN minx IS NULL THEN 'unknown' WHEN minx > maxx OR miny > maxy THEN 'reversed' ELSE 'ok' END AS state FROM extent", "extent")
def normalise_extent(v):
    return C.normalise_extent(v.view("extent")).select("path", "state")


@query("scan_extents", "SELECT path, NOT (scan % 4 = 0 OR scan % 5 = 0) AS reused FROM extent", "extent")
def scan_extents(v):
    listing = v.view("extent").select("path", "size", "mtime", "scan")
    cached = listing.where("scan % 5 <> 0").select("path", "size", F.when(F.col("scan") % 4 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.lit("raster").alias("kind"))
    return C.scan_extents(listing, cached, lambda new: new.select("path", "size", "mtime", F.lit("raster").alias("kind"))).select("path", "reused")


@query("rank_files", """WITH s AS (SELECT *, CASE WHEN minx IS NULL OR minx > maxx THEN 'unknown' ELSE 'overlap' END AS coverage FROM extent)
 SELECT path, coverage, ROW_NUMBER() OVER (ORDER BY coverage <> 'overlap', LOWER(name), LOWER(path)) AS place FROM s
 WHERE coverage = 'unknown' OR (minx <= 2 AND maxx >= 1 AND miny <= 5 AND maxy >= 1)""", "extent")
def rank_files(v):
    files = C.overlapping_files(C.normalise_extent(v.view("extent")), Bounds(1.0, 1.0, 5.0, 2.0))
    return C.rank_files(files).select("path", "coverage", "place")


@query("classify_sources", """SELECT o_orderkey AS source, CASE WHEN o_custkey % 5 = 0 THEN 'rejected' WHEN o_custkey % 7 = 0 THEN 'rejected' WHEN o_custkey % 11 = 0 OR o_custkey % 3 = 0 THEN 'needs review' ELSE 'accepted' END AS state,
 CASE WHEN o_custkey % 5 = 0 THEN 'image band' WHEN o_custkey % 7 = 0 THEN 'no coordinate system' WHEN o_custkey % 11 = 0 THEN 'no grid transform' WHEN o_custkey % 3 = 0 THEN 'several bands' END AS reason,
 CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'EPSG:3006' END AS horizontal, CASE WHEN o_custkey % 7 <> 0 AND o_custkey % 2 = 0 THEN 'RH2000' ELSE 'Unknown / unchanged' END AS datum, FALSE AS synthetic FROM orders""")
def classify_sources(v):
    rows = v.table("orders").selectExpr(
        "o_orderkey AS source", "CASE WHEN o_custkey % 5 = 0 THEN 'Red' ELSE 'gray' END AS interp", "'float32' AS dtype",
        "CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'EPSG:3006 + RH2000' ELSE 'EPSG:3006' END AS crs", "CAST(NULL AS STRING) AS crs_override",
        "o_custkey % 11 <> 0 AS has_affine", "CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END AS bands", "CAST(NULL AS STRING) AS datum_tag", "'no' AS synthetic")
    return C.classify_sources(rows)


@query("source_priority", """SELECT o_orderkey AS file_pos, o_custkey AS map_id, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY ROUND(GREATEST(o_orderkey % 7, o_orderkey % 3), 6), o_orderkey) AS priority FROM orders""")
def source_priority(v):
    rows = v.table("orders").selectExpr("o_orderkey AS file_pos", "o_custkey AS map_id", "CAST(o_orderkey % 7 AS DOUBLE) AS rx", "CAST(o_orderkey % 3 AS DOUBLE) AS ry")
    return C.source_priority(rows).select("file_pos", "map_id", "priority")
