"""Round trips through files and whole jobs: what is derived from the tables is written in a format and read back by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geoloom.plans.pipelines import TerrainOptions, build_terrain, convert_map
from geoloom.plans.raster_queries import NEAR, REACH, SAMPLES, samples
from geoloom.plans.registry import query
from geoloom.plans.scalar_queries import GUIDES, NETVIEWS, TEMPLATE
from geoloom.plans.views import SPEC
from geoloom.session import scratch_dir
from geoloom.sources import dataset as D
from geoloom.sources.points import read_points, write_las
from geoloom.sources.rasters import read_ascii_grid, read_hgt, write_ascii_grid, write_hgt
from geoloom.spec import GridSpec


def folder_of(v) -> str:
    return f"{scratch_dir(v.spark)}/files-{uuid.uuid4().hex}"


BOX = (20.0, 2.0, 1500.0, 60.0)


@query("read_points", f"""SELECT CAST(l_partkey AS BIGINT) AS x, CAST(l_suppkey AS BIGINT) AS y, CAST(l_quantity AS BIGINT) AS z, l_linenumber % 3 + 1 AS classification, l_returnflag = 'R' AS withheld,
 COUNT(*) AS n FROM lineitem WHERE l_partkey BETWEEN {BOX[0]} AND {BOX[2]} AND l_suppkey BETWEEN {BOX[1]} AND {BOX[3]} GROUP BY ALL""")
def points(v):
    """Line items as points of LAS files, those of a box read back."""
    folder = folder_of(v)
    rows = v.table("lineitem").selectExpr("l_partkey AS x", "l_suppkey AS y", "l_quantity AS z", "l_linenumber % 3 + 1 AS classification", "l_returnflag = 'R' AS withheld")
    write_las(rows, folder)
    whole = lambda c: F.rint(c).cast("long").alias(c)
    return read_points(v.spark, f"{folder}/*.las", box=BOX).groupBy(whole("x"), whole("y"), whole("z"), "classification", "withheld").agg(F.count(F.lit(1)).alias("n"))


TILED = "SELECT (c_custkey - {0}) // {1} AS tile, (c_custkey - {0}) % {1} AS cell, {2} AS z FROM customer"
FIRST = "(SELECT MIN(c_custkey) FROM customer)"


def tiled(v, cells: int, z: str):
    first = v.table("customer").agg(F.min("c_custkey").alias("first"))
    place = v.table("customer").crossJoin(F.broadcast(first)).withColumn("at", F.col("c_custkey") - F.col("first"))  # one row
    return place.select(F.floor(F.col("at") / cells).cast("long").alias("tile"), (F.col("at") % cells).cast("long").alias("cell"), F.expr(z).alias("z"))


@query("read_hgt", f"""WITH t AS ({TILED.format(FIRST, 81, 'CAST(FLOOR(c_acctbal) AS BIGINT)')}),
 g AS (SELECT tile, cell FROM (SELECT DISTINCT tile FROM t), range(81) r(cell))
 SELECT 'N' || LPAD(CAST(tile % 80 AS VARCHAR), 2, '0') || 'E' || LPAD(CAST(tile // 80 % 180 AS VARCHAR), 3, '0') || '.hgt' AS source, cell // 9 AS row, cell % 9 AS col,
  CAST(FLOOR((tile % 80 + 1 - (cell // 9) / 8e0) * 1e4 + 0.5) AS BIGINT) AS lat, CAST(FLOOR((tile // 80 % 180 + (cell % 9) / 8e0) * 1e4 + 0.5) AS BIGINT) AS lon, z FROM g LEFT JOIN t USING (tile, cell)""")
def hgt(v):
    """Account balances as heights of 9 x 9 tiles; the last tile has voids."""
    folder, tile = folder_of(v), F.col("tile")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    name = F.concat(F.lit("N"), pad(tile % 80, 2), F.lit("E"), pad(F.floor(tile / 80) % 180, 3), F.lit(".hgt"))
    rows = tiled(v, 81, "CAST(floor(c_acctbal) AS DOUBLE)").select(name.alias("source"), F.floor(F.col("cell") / 9).alias("row"), (F.col("cell") % 9).alias("col"), "z")
    write_hgt(rows.unionByName(rows.select("source").distinct().select("source", F.lit(8).cast("long").alias("row"), F.lit(8).cast("long").alias("col"), F.lit(None).cast("double").alias("z"))
                               .join(rows.select("source", "row", "col"), ["source", "row", "col"], "left_anti").select("source", "row", "col", "z")), folder)
    fine = lambda c: F.floor(F.col(c) * 1e4 + 0.5).alias(c)
    return read_hgt(v.spark, f"{folder}/*.hgt").select("source", "row", "col", fine("lat"), fine("lon"), F.col("z").cast("long").alias("z"))


@query("read_ascii_grid", f"""WITH t AS ({TILED.format(FIRST, 64, 'CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END')})
 SELECT 'g' || CAST(tile AS VARCHAR) || '.asc' AS source, cell // 8 AS row, cell % 8 AS col, CAST((cell % 8) * 2 + 1 AS BIGINT) AS x,
  CAST((MAX(cell // 8) OVER (PARTITION BY tile) - cell // 8) * 2 + 1 AS BIGINT) AS y, CAST(FLOOR(z * 100 + 0.5) AS BIGINT) AS z FROM t WHERE tile < (SELECT MAX(tile) FROM t)""")
def ascii_grid(v):
    """Account balances as 8 x 8 grids with voids; the last, unfinished grid is left out, as a line of such a file has all its columns."""
    folder = folder_of(v)
    rows = tiled(v, 64, "CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_acctbal AS DOUBLE) END")
    last = rows.agg(F.max("tile").alias("last"))
    rows = rows.crossJoin(F.broadcast(last)).where("tile < last")  # one row
    rows = rows.select(F.concat(F.lit("g"), F.col("tile").cast("string"), F.lit(".asc")).alias("source"), F.floor(F.col("cell") / 8).alias("row"), (F.col("cell") % 8).alias("col"), "z")
    write_ascii_grid(rows, folder, 2.0)
    whole = lambda c: F.rint(c).cast("long").alias(c)
    return read_ascii_grid(v.spark, f"{folder}/*.asc").select("source", "row", "col", whole("x"), whole("y"), F.floor(F.col("z") * 100 + 0.5).cast("long").alias("z"))


@query("read_report", """SELECT 'd' || CAST(c_nationkey AS VARCHAR) AS dataset, COUNT(*) AS edges, CAST(MIN(c_custkey) AS BIGINT) AS west, CAST(MAX(c_custkey) AS BIGINT) AS width,
 CAST(c_nationkey % 3 AS VARCHAR) AS style FROM customer GROUP BY c_nationkey""")
def report(v):
    """One report a nation, with fields that are dropped."""
    folder = folder_of(v)
    rows = v.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("edges"), F.min("c_custkey").cast("double").alias("a"), F.max("c_custkey").cast("double").alias("b"))
    rows = rows.select(F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("dataset"), "edges", F.array("a", F.lit(0.0), "b", F.lit(1.0)).alias("bounds"),
                       F.array("b", F.lit(1.0)).alias("mapSize"), F.create_map(F.lit("style"), (F.col("c_nationkey") % 3).cast("string")).alias("settings"), F.lit("dropped").alias("notes"))
    # One object a file, as reports are: a line of JSON text in a partition of its own.
    rows.select(F.to_json(F.struct("*")).alias("value"), F.col("dataset").alias("part")).write.partitionBy("part").text(folder)
    out = D.read_report(v.spark, f"{folder}/part=*/*.txt")
    return out.select("dataset", "edges", F.get("bounds", F.lit(0)).cast("long").alias("west"), F.get("mapSize", F.lit(0)).cast("long").alias("width"), F.col("settings")["style"].alias("style"))


@query("read_map_dataset", """SELECT 'labels' AS name, COUNT(*) AS n, CAST(SUM(rank) AS BIGINT) AS total FROM label UNION ALL SELECT 'patches', COUNT(*), CAST(SUM(id) AS BIGINT) FROM patch""", "label patch")
def map_dataset(v):
    """Two tables written as a dataset, read back against its manifest, its id, bounds and size."""
    folder, tables = folder_of(v), {"labels": v.view("label"), "patches": v.view("patch")}
    what = {"bounds": [0.0, 0.0, 0.01, 0.01], "mapSize": [1024, 1024]}
    name = D.write_map_dataset(tables, folder, what)
    read, _ = D.read_map_dataset(v.spark, folder, {k: t.schema for k, t in tables.items()}, expected={**what, "dataset": name})
    count = lambda k, c: read[k].agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(c).cast("long").alias("total"))
    return count("labels", "rank").unionByName(count("patches", "id"))


GAPPY = f"s AS ({SAMPLES}), best AS (SELECT layer, row, col, ARG_MIN(z, priority) AS z FROM s WHERE z IS NOT NULL GROUP BY 1, 2, 3), vertex AS (SELECT e.*, b.z FROM (SELECT DISTINCT layer, row, col FROM s) e LEFT JOIN best b USING (layer, row, col))"


@query("build_terrain", f"WITH {GAPPY}, {NEAR.replace('cell', 'vertex').removeprefix('WITH ')} SELECT layer, row, col, CAST(FLOOR((z * 15e-1 - 20) * 1000 + 0.5) AS BIGINT) AS z FROM filled")
def terrain(v):
    """Quantities of three sources as heights: the first valid source, gaps filled, scaled."""
    out = build_terrain(samples(v), ["layer"], GridSpec(252.0, 252.0, 64, 64), TerrainOptions(fill_m=REACH, keep_gaps=True, scale=1.5, offset=-20.0))
    return out["cells"].select("layer", "row", "col", F.floor(F.col("z") * 1000 + 0.5).cast("long").alias("z"))


@query("convert_map", GUIDES.rstrip() + f""", styled AS (SELECT way_id, {TEMPLATE} AS cls FROM way)
 SELECT 'edges' AS part, CASE WHEN kind = 'rail' THEN 'TRACK' ELSE 'STREET' END || ':' || cls AS name, COUNT(*) AS n FROM piece JOIN styled USING (way_id) GROUP BY ALL
 UNION ALL SELECT 'issues', 'referenced node does not exist', COUNT(DISTINCT node_id) FROM way_node WHERE node_id NOT IN (SELECT node_id FROM node)""", NETVIEWS + " node")
def whole_map(v):
    """The derived extract as a map dataset: edges by style and missing nodes counted."""
    refs = v.way_node.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("seq", "node_id"))).alias("r")).select("way_id", F.col("r.node_id").alias("refs"))
    none = v.spark.createDataFrame([], "rel_id long, tags map<string,string>, members array<struct<type:string,ref:bigint,role:string>>")
    out = convert_map(v.nodes, v.ways.join(refs, "way_id"), none, SPEC)
    edges = out["edges"].groupBy(F.concat_ws(":", "kind", "cls").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("part"), "name", "n")
    lost = out["issues"].where("reason = 'referenced node does not exist'").groupBy(F.col("reason").alias("name")).agg(F.countDistinct("area").alias("n")).select(F.lit("issues").alias("part"), "name", "n")
    return edges.unionByName(lost)
