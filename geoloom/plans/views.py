"""Map-like tables derived from the given tables, for queries and their SQL twins.

Each view is a table and a list of (name, expression). Expressions are plain SQL that means the same in
both engines, so ``Views`` selects them in Spark and ``view_sql`` prints them as common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.functions.geo import project_xy
from geoloom.operators.ordered import block_row_number
from geoloom.session import prepare, settle
from geoloom.spec import Bounds, MapSpec

SPEC = MapSpec(Bounds(0.0, 0.0, 0.01, 0.01), 1024.0, 1024.0)
GRID = 64          # side of the height layers derived from orders
GRID_SPAN = 252.0  # (GRID - 1) * 4 metres

NODE_TAGS = [
    ("natural", "CASE WHEN p_type = 'STANDARD' THEN 'tree' WHEN p_type = 'SMALL' AND p_size > 40 THEN 'spring' END"),
    ("amenity", "CASE WHEN p_type = 'ECONOMY' AND p_size <= 10 THEN 'fountain' WHEN p_type = 'ECONOMY' AND p_size <= 20 "
                "THEN 'bench' WHEN p_type = 'ECONOMY' AND p_size <= 30 THEN 'cafe' END"),
    ("barrier", "CASE WHEN p_type = 'PROMO' AND p_size <= 25 THEN 'bollard' END"),
    ("advertising", "CASE WHEN p_type = 'LARGE' AND p_size <= 25 THEN 'column' END"),
    ("railway", "CASE WHEN p_type = 'MEDIUM' AND p_size <= 25 THEN 'signal' WHEN p_type = 'LARGE' AND p_size > 45 THEN 'rail' END"),
    ("place", "CASE p_size WHEN 41 THEN 'city' WHEN 42 THEN 'town' WHEN 43 THEN 'village' WHEN 44 THEN 'hamlet' "
              "WHEN 45 THEN 'suburb' WHEN 46 THEN 'locality' END"),
    ("name", "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END"),
    ("building", "CASE WHEN p_type = 'SMALL' AND p_size <= 9 THEN 'house' WHEN p_type = 'SMALL' AND p_size <= 15 THEN 'retail' "
                 "WHEN p_type = 'SMALL' AND p_size <= 20 THEN 'factory' WHEN p_type = 'SMALL' AND p_size <= 25 THEN 'yes' "
                 "WHEN p_size = 50 THEN 'no' END"),
    ("height", "CASE p_size % 6 WHEN 0 THEN p_size || ' m' WHEN 1 THEN p_size || 'ft' WHEN 2 THEN CAST(p_size AS STRING) "
               "WHEN 3 THEN 'tall' WHEN 4 THEN p_size || '00' END"),
]
WAY_TAGS = [
    ("highway", "CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary' "
                "WHEN '3-MEDIUM' THEN 'residential' WHEN '4-NOT SPECIFIED' THEN 'footway' END"),
    ("railway", "CASE WHEN o_orderkey % 11 = 0 THEN 'rail' WHEN o_orderkey % 13 = 0 THEN 'tram' "
                "WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'disused' END"),
    ("oneway", "CASE o_orderkey % 7 WHEN 0 THEN '-1' WHEN 1 THEN 'YES' WHEN 2 THEN 'no' END"),
    ("junction", "CASE WHEN o_custkey % 19 = 0 THEN 'roundabout' END"),
    ("lanes", "CASE WHEN o_orderkey % 6 = 0 THEN 'x' ELSE CAST(o_orderkey % 6 AS STRING) END"),
    ("maxspeed", "CASE o_custkey % 4 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN '170 km/h' ELSE 'signals' END"),
    ("bridge", "CASE o_orderkey % 29 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END"),
    ("tunnel", "CASE WHEN o_orderkey % 31 = 0 THEN 'yes' END"),
    ("area", "CASE o_custkey % 23 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END"),
    ("lit", "CASE WHEN o_custkey % 5 = 0 THEN 'yes' END"),
    ("electrified", "CASE o_custkey % 3 WHEN 0 THEN 'contact_line' WHEN 1 THEN 'no' END"),
    ("gauge", "CASE o_custkey % 9 WHEN 0 THEN '1000' WHEN 1 THEN '1435' END"),
    ("natural", "CASE o_custkey % 12 WHEN 0 THEN 'wood' WHEN 1 THEN 'scrub' WHEN 2 THEN 'water' WHEN 3 THEN 'grassland' "
                "WHEN 4 THEN 'wetland' WHEN 5 THEN 'sand' WHEN 6 THEN 'bare_rock' END"),
    ("landuse", "CASE o_custkey % 10 WHEN 0 THEN 'forest' WHEN 1 THEN 'grass' WHEN 2 THEN 'basin' WHEN 3 THEN 'reservoir' "
                "WHEN 4 THEN 'farmland' WHEN 5 THEN 'construction' END"),
    ("surface", "CASE o_custkey % 8 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN '' WHEN 3 THEN 'sett' END"),
    ("water", "CASE o_custkey % 14 WHEN 0 THEN 'pond' WHEN 1 THEN 'lake' WHEN 2 THEN 'river' WHEN 3 THEN 'no' "
              "WHEN 4 THEN 'fishpond' END"),
    ("waterway", "CASE o_custkey % 16 WHEN 0 THEN 'stream' WHEN 1 THEN 'riverbank' WHEN 2 THEN 'dam' WHEN 3 THEN '' END"),
    ("width", "CASE o_custkey % 6 WHEN 0 THEN '4' WHEN 1 THEN '3.5 m' WHEN 2 THEN 'wide' WHEN 3 THEN '55' END"),
    ("est_width", "CASE WHEN o_custkey % 5 = 0 THEN '2' END"),
    ("building", "CASE o_custkey % 15 WHEN 0 THEN 'house' WHEN 1 THEN 'office' WHEN 2 THEN 'warehouse' WHEN 3 THEN 'no' END"),
    ("man_made", "CASE WHEN o_custkey % 17 = 0 THEN 'water_tower' WHEN o_custkey % 17 = 1 THEN 'pier' END"),
    ("amenity", "CASE WHEN o_custkey % 21 = 0 THEN 'bench' WHEN o_custkey % 21 = 1 THEN 'school' END"),
]

VIEWS = {
    "node": ("part", [("node_id", "p_partkey"), ("lat", "((p_partkey * 7919) % 11003) / 1e6"),
                      ("lon", "((p_partkey * 104729) % 11027) / 1e6"), *[("t_" + k, v) for k, v in NODE_TAGS]]),
    "way": ("orders", [("way_id", "o_orderkey"), ("k", "o_custkey"), *[("t_" + k, v) for k, v in WAY_TAGS]]),
    # Ground points: one survey per thousand orders, on a 65 x 65 grid of 4 m cells.
    "point": ("lineitem", [
        ("survey", "CAST(FLOOR(l_orderkey / 1000) AS BIGINT)"),
        ("x", "((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 521) * 5e-1 - 13e1"),
        ("y", "((l_partkey * 17 + l_suppkey * 3) % 521) * 5e-1 - 13e1"), ("z", "l_quantity"),
        ("classification", "CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END"), ("withheld", "l_linenumber = 7")]),
    # Height layers of 64 x 64 vertices, as many as the orders fill.
    "cell": ("orders", [
        ("layer", "CAST(FLOOR(o_orderkey / 4096) AS BIGINT)"), ("row", "CAST(FLOOR(o_orderkey / 64) AS BIGINT) % 64"),
        ("col", "o_orderkey % 64"),
        ("z", "CASE WHEN o_custkey % 31 = 0 THEN NULL ELSE 1e2 + (o_orderkey % 64) * 2e0 + (o_custkey % 17) END")]),
    "dense": ("orders", [
        ("layer", "CAST(FLOOR(o_orderkey / 4096) AS BIGINT)"), ("row", "CAST(FLOOR(o_orderkey / 64) AS BIGINT) % 64"),
        ("col", "o_orderkey % 64"), ("z", "1e2 + (o_orderkey % 64) * 2e0 + (o_custkey % 17)")]),
    "stroke": ("events", [
        ("layer", "CAST(FLOOR(event_id / 2731) AS BIGINT)"), ("seq", "event_id"),
        ("tool", "CASE event_type WHEN 'click' THEN 'Raise' WHEN 'view' THEN 'Lower' WHEN 'signup' THEN 'Raise' ELSE 'Flatten' END"),
        ("x", "(user_id * 7 + event_id * 3) % 253 - 126e0"), ("y", "(event_id * 5) % 253 - 126e0"),
        ("radius", "5e0 + event_id % 20"), ("strength", "(1 + event_id % 4) * 25e-2"),
        ("target", "1e2 + user_id % 50"), ("biome", "CAST(user_id % 5 AS INT)")]),
    "candidate": ("part", [
        ("name", "'m' || CAST(p_partkey AS STRING)"),
        ("kind", "CASE p_type WHEN 'STANDARD' THEN 'residential' WHEN 'SMALL' THEN 'commercial' WHEN 'LARGE' THEN 'industrial' "
                 "WHEN 'ECONOMY' THEN 'bench' ELSE 'rock' END"),
        ("tier", "CAST(p_partkey % 2 AS INT)"), ("width", "1e0 + p_size % 9"), ("length", "1e0 + p_size % 7"),
        ("height", "p_size * 25e-2")]),
    "label": ("customer", [
        ("rank", "c_custkey"), ("name", "c_mktsegment || CAST(c_nationkey AS STRING)"),
        ("x", "(c_custkey * 37) % 2011 - 1e3"), ("y", "(c_custkey * 53) % 2017 - 1e3")]),
    "patch": ("customer", [
        ("id", "c_custkey"), ("map_id", "CAST(FLOOR(c_custkey / 100) AS BIGINT)"), ("x", "(c_custkey * 37) % 300 - 15e1"),
        ("y", "(c_custkey * 53) % 290 - 145e0"), ("length", "8e0 + c_custkey % 23"), ("width", "8e0 + c_custkey % 19"),
        ("margin", "CASE WHEN c_custkey % 2 = 0 THEN 1e1 ELSE 0e0 END")]),
    "asset": ("orders", [
        ("catalog_id", "o_custkey % 25"), ("url", "'https://data.example/' || CAST(o_custkey AS STRING) || "
                       "CASE WHEN o_orderkey % 9 = 0 THEN '.txt' ELSE '.tif' END"),
        ("date", "SUBSTR(CAST(o_orderdate AS STRING), 1, 10)"), ("bytes", "o_orderkey * 1000"),
        ("minx", "(o_custkey % 50) / 10e0 - 1"), ("miny", "(o_custkey % 40) / 10e0 - 1"),
        ("maxx", "(o_custkey % 50) / 10e0 - 5e-1"), ("maxy", "(o_custkey % 40) / 10e0 - 5e-1")]),
    "extent": ("orders", [
        ("path", "'dem/' || CAST(o_orderkey AS STRING) || '.tif'"), ("name", "CAST(o_custkey AS STRING) || '.tif'"),
        ("scan", "o_orderkey"), ("size", "o_orderkey * 10"), ("mtime", "o_custkey"),
        ("minx", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey % 100) * 1e-1 END"),
        ("miny", "(o_custkey % 90) * 1e-1"),
        ("maxx", "(o_custkey % 100) * 1e-1 + CASE WHEN o_custkey % 13 = 0 THEN -1 ELSE 1 END"),
        ("maxy", "(o_custkey % 90) * 1e-1 + 1")]),
    "expected": ("orders", [
        ("edge_no", "o_orderkey"), ("node0", "o_custkey"), ("node1", "o_custkey + 1 + o_orderkey % 3"),
        ("cls", "o_orderpriority"), ("kind", "CASE WHEN o_orderkey % 4 = 0 THEN 'TRACK' ELSE 'STREET' END")]),
}

# Unit outlines of the three area shapes; x = cx + ux * w, y = cy + uy * h.
SHAPES = [
    (0, 0, [(0, 0), (1, 0), (1, 1), (0, 1)]),
    (1, 0, [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]),
    (2, 0, [(0, 0), (3, 0), (3, 3), (0, 3)]),
    (2, 1, [(1, 1), (2, 1), (2, 2), (1, 2)]),
]
OUTLINE = [(s, r, i, len(pts), float(ux), float(uy)) for s, r, pts in SHAPES for i, (ux, uy) in enumerate(pts)]

AREA = ("customer", [
    ("area_id", "c_custkey"), ("map_id", "CAST(FLOOR(c_custkey / 100) AS BIGINT)"), ("shape", "CAST(c_custkey % 3 AS INT)"),
    ("cx", "(c_custkey * 37) % 900 - 45e1"), ("cy", "(c_custkey * 53) % 900 - 45e1"), ("w", "8e0 + c_custkey % 23"),
    ("h", "8e0 + c_custkey % 19")])

REF_ORDER = ["l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
REF_NODE = "CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN -1 - l_partkey ELSE l_partkey END"


class Views:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        table, columns = VIEWS[name]
        return self.table(table).selectExpr(*[f"{e} AS {a}" for a, e in columns])

    def _tagged(self, name: str) -> DataFrame:
        df = self.view(name)
        keys = [c for c in df.columns if c.startswith("t_")]
        pairs = [part for c in keys for part in (F.lit(c[2:]), F.col(c))]
        return df.withColumn("tags", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())).drop(*keys)

    # Tagged entities are tables of their own, as a reader of map extracts would have landed them.
    @cached_property
    def nodes(self) -> DataFrame:
        return settle(self._tagged("node"))

    @cached_property
    def ways(self) -> DataFrame:
        return settle(self._tagged("way"))

    @cached_property
    def position(self) -> DataFrame:
        """Landed as in the pipelines: the files of the given table are so small for their rows that a plan would broadcast millions of positions."""
        x, y = project_xy("lat", "lon", SPEC)
        return settle(self.view("node").select("node_id", x.alias("x"), y.alias("y")))

    @cached_property
    def references(self) -> int:
        """Rows of ``way_node``, read from the footers of the files."""
        return self.table("lineitem").count()

    @cached_property
    def way_node(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", *REF_ORDER)
        ranked = block_row_number(lines, ["l_orderkey"], REF_ORDER, F.floor(F.col("l_partkey") / 4096), "seq", self.references)
        return settle(ranked.select(F.col("l_orderkey").alias("way_id"), (F.col("seq") - 1).alias("seq"),
                                    F.expr(REF_NODE).alias("node_id")))

    @property
    def areas(self) -> DataFrame:
        table, columns = AREA
        return self.table(table).selectExpr(*[f"{e} AS {a}" for a, e in columns])

    @property
    def rings(self) -> DataFrame:
        """Ring vertices: area_id, map_id, ring, idx, n, x, y."""
        outline = self.spark.createDataFrame(OUTLINE, "shape int, ring int, idx int, n int, ux double, uy double")
        return self.areas.join(F.broadcast(outline), "shape").select(
            "area_id", "map_id", "ring", "idx", "n", (F.col("cx") + F.col("ux") * F.col("w")).alias("x"),
            (F.col("cy") + F.col("uy") * F.col("h")).alias("y"))


def _select(table: str, columns) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{a}"' for a, e in columns) + f" FROM {table}"


_OUTLINE_SQL = ", ".join(f"({s}, {r}, {i}, {n}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for s, r, i, n, x, y in OUTLINE)
_MY = "LN(TAN(PI() / 4 + RADIANS({0}) / 2))"
EXTRA_SQL = {
    "pos": ("node", "SELECT node_id, ((lon - 0) / 1e-2 - 5e-1) * 1024 AS x, ((" + _MY.format("lat") + " - " + _MY.format("0e0")
            + ") / (" + _MY.format("1e-2") + " - " + _MY.format("0e0") + ") - 5e-1) * 1024 AS y FROM node"),
    "way_node": ("", "SELECT l_orderkey AS way_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY "
                 + ", ".join(REF_ORDER) + f") - 1 AS seq, {REF_NODE} AS node_id FROM lineitem"),
    "located": ("way_node pos", "SELECT wn.*, p.x, p.y FROM way_node wn LEFT JOIN pos p USING (node_id)"),
    "seg": ("located", "SELECT * FROM (SELECT way_id, seq, node_id AS node0, LEAD(node_id) OVER w AS node1, x AS x0, y AS y0, "
            "LEAD(x) OVER w AS x1, LEAD(y) OVER w AS y1, LEAD(seq) OVER w AS nseq FROM located "
            "WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE nseq IS NOT NULL"),
    "clip": ("seg", "SELECT *, x0 + low * (x1 - x0) AS cx0, y0 + low * (y1 - y0) AS cy0, x0 + high * (x1 - x0) AS cx1, "
             "y0 + high * (y1 - y0) AS cy1 FROM (SELECT *, "
             "GREATEST(0e0, CASE WHEN x1 - x0 > 1e-12 THEN (-512 - x0) / (x1 - x0) WHEN x1 - x0 < -1e-12 THEN (512 - x0) / (x1 - x0) END, "
             "CASE WHEN y1 - y0 > 1e-12 THEN (-512 - y0) / (y1 - y0) WHEN y1 - y0 < -1e-12 THEN (512 - y0) / (y1 - y0) END) AS low, "
             "LEAST(1e0, CASE WHEN x1 - x0 > 1e-12 THEN (512 - x0) / (x1 - x0) WHEN x1 - x0 < -1e-12 THEN (-512 - x0) / (x1 - x0) END, "
             "CASE WHEN y1 - y0 > 1e-12 THEN (512 - y0) / (y1 - y0) WHEN y1 - y0 < -1e-12 THEN (-512 - y0) / (y1 - y0) END) AS high "
             "FROM seg WHERE x0 IS NOT NULL AND x1 IS NOT NULL) WHERE low <= high AND (ABS(x1 - x0) >= 1e-12 OR ABS(x0) <= 512) "
             "AND (ABS(y1 - y0) >= 1e-12 OR ABS(y0) <= 512)"),
    "area": ("", _select(*AREA)),
    "outline": ("", f"SELECT * FROM (VALUES {_OUTLINE_SQL}) AS o(shape, ring, idx, n, ux, uy)"),
    "rings": ("area outline", "SELECT area_id, map_id, ring, idx, n, cx + ux * w AS x, cy + uy * h AS y "
              "FROM area JOIN outline USING (shape)"),
    "ring_edge": ("rings", "SELECT a.area_id, a.map_id, a.ring, a.idx, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM rings a "
                  "JOIN rings b ON a.area_id = b.area_id AND a.ring = b.ring AND b.idx = (a.idx + 1) % a.n"),
}


def view_sql(names: str) -> str:
    """'WITH ...' text that defines the named views and all they need, in order."""
    order: list[str] = []

    def add(name: str):
        if name not in order:
            for need in (EXTRA_SQL[name][0].split() if name in EXTRA_SQL else []):
                add(need)
            order.append(name)

    for name in names.split():
        add(name)
    body = [f'{n} AS ({EXTRA_SQL[n][1] if n in EXTRA_SQL else _select(*VIEWS[n])})' for n in order]
    return "WITH " + ", ".join(body) + " " if body else ""
