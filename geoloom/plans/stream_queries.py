"""Queries that run streams to the end of the given tables, and round trips through files."""

import uuid

from pyspark.sql import functions as F

from geoloom.functions.geo import mm
from geoloom.plans import raster_queries as RQ
from geoloom.plans.join_queries import MEMBERS, members
from geoloom.plans.network_queries import MM
from geoloom.plans.registry import query
from geoloom.plans.scalar_queries import items
from geoloom.plans.views import VIEWS
from geoloom.session import shared_dir
from geoloom.sources import dataset as D, osm as O
from geoloom.streaming.apply import latest_cells, store_cells, stream_apply_features, stream_strokes
from geoloom.streaming.ground_grid import stream_ground_grid

FILE_ROWS = 500_000  # rows of a file, which one task reads
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(v, name):
    return f"{shared_dir(v.spark)}/geoloom/{name}-{uuid.uuid4().hex}"


def stream(v, table, order, pieces=3):
    """A given table as a stream of several batches: it is cut into pieces that arrive one after another, by ``order``, each in as many files as its rows ask."""
    df, path = v.table(table), scratch(v, table)
    cuts = df.agg(F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 1000)).first()[0] or []
    bounds, files = [None, *cuts, None], max(1, -(-df.count() // (pieces * FILE_ROWS)))
    for low, high in zip(bounds[:-1], bounds[1:]):
        part = df if low is None else df.where(F.col(order) > low)
        (part if high is None else part.where(F.col(order) <= high)).repartition(files).write.mode("append").parquet(path)
    if len(v.spark.read.parquet(path).inputFiles()) != pieces * files:
        raise RuntimeError("a piece of the stream lacks files, so batches would not be pieces")
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def view_stream(v, name, order):
    table, columns = VIEWS[name]
    return stream(v, table, order).selectExpr(*[f"{e} AS {a}" for a, e in columns])


def land(v, df, mode, name):
    """Run a stream to its end and read what it wrote, with the batch number of each row."""
    path = scratch(v, name)

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.schema(df.schema.add("batch", "long")).parquet(f"{path}/rows/*")


@query("stream_ground_grid", f"WITH g AS ({RQ.GROUND}) SELECT survey, row, col, {MM.format('SUM(z) / COUNT(*)', 'z')}, COUNT(*) AS points FROM g GROUP BY survey, row, col", "point")
def ground_grid(v):
    rows = land(v, stream_ground_grid(view_stream(v, "point", "l_orderkey"), ["survey"], RQ.FIELD), "update", "ground")
    last = rows.groupBy("survey", "row", "col").agg(F.max(F.struct("batch", "total", "points")).alias("s"))
    return last.select("survey", "row", "col", mm(F.col("s.total") / F.col("s.points")).alias("z"), "s.points")


@query("stream_apply_features", "SELECT o_custkey % 10 AS dataset_id, o_orderstatus AS section, COUNT(*) AS entities, MIN(o_orderkey) AS first, MAX(o_orderkey) AS last FROM orders GROUP BY 1, 2")
def apply_features(v):
    rows = stream(v, "orders", "o_orderkey").selectExpr("o_custkey % 10 AS dataset_id", "o_orderstatus AS section", "o_orderkey AS index", "o_totalprice AS value")
    path = scratch(v, "features")
    stream_apply_features(rows, path, f"{path}-checkpoint", step_limit=1)
    stream_apply_features(rows, path, f"{path}-checkpoint")  # the next run goes on
    stream_apply_features(rows, path, f"{path}-checkpoint")  # and one more finds nothing new
    journal = v.spark.read.schema("dataset_id long, section string, first long, last long, entities long, status string").parquet(f"{path}/journal/*")
    return journal.groupBy("dataset_id", "section").agg(F.sum("entities").alias("entities"), F.min("first").alias("first"), F.max("last").alias("last"))


def _strokes_sql():
    from geoloom.plans.registry import ORACLES
    return ORACLES["apply_strokes"]


@query("stream_strokes", _strokes_sql())
def strokes(v):
    path = scratch(v, "cells")
    store_cells(v.view("dense"), path, ["layer"])
    stream_strokes(view_stream(v, "stroke", "event_id"), path, ["layer"], RQ.TILE, f"{path}-checkpoint")
    return latest_cells(v.spark, path, ["layer"]).withColumn("z", mm("z"))


@query("write_map_dataset", "SELECT 'cells' AS name, COUNT(*) AS n, CAST(SUM(row) AS BIGINT) AS total FROM cell UNION ALL SELECT 'items', COUNT(*), CAST(SUM(o_orderkey) AS BIGINT) FROM orders", "cell")
def write_map_dataset(v):
    tables = {"cells": v.view("cell"), "items": items(v)}
    path = scratch(v, "dataset")
    D.write_map_dataset(tables, path, {"bounds": [0, 0, 0.01, 0.01], "size": [1024, 1024]})
    back, _ = D.read_map_dataset(v.spark, path, {n: t.schema for n, t in tables.items()})
    total = lambda n, c: back[n].agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total")).select(F.lit(n).alias("name"), "n", "total")
    return total("cells", "row").unionByName(total("items", "item_id"))


@query("write_height_tiles", """WITH r AS (SELECT layer, FLOOR(MIN(z)) AS lo, CASE WHEN CEIL(MAX(z)) = FLOOR(MIN(z)) THEN FLOOR(MIN(z)) + 1 ELSE CEIL(MAX(z)) END AS hi FROM dense GROUP BY layer)
 SELECT layer, CAST(FLOOR(row / 16) AS INT) AS tr, CAST(FLOOR(col / 16) AS INT) AS tc, COUNT(*) AS n, CAST(SUM(z) AS BIGINT) AS total, CAST(SUM(ROUND_EVEN((z - lo) / (hi - lo) * 65535, 0)) AS BIGINT) AS codes,
  CAST(SUM(row % 5) AS BIGINT) AS biomes, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM dense JOIN r USING (layer) GROUP BY ALL""", "dense")
def write_height_tiles(v):
    path = scratch(v, "tiles")
    D.write_height_tiles(v.view("dense").withColumn("biome", (F.col("row") % 5).cast("int")), path, ["layer"], 16)
    tiles = v.spark.read.parquet(f"{path}/tiles").groupBy("layer", "tr", "tc").agg(
        F.count(F.lit(1)).alias("n"), F.sum("z").cast("long").alias("total"), F.sum("code").cast("long").alias("codes"), F.sum("biome").cast("long").alias("biomes"))
    return tiles.join(v.spark.read.parquet(f"{path}/ranges").select("layer", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")), "layer")


@query("read_osm", f"""WITH m AS ({MEMBERS}) SELECT 'node' AS kind, COUNT(*) AS n, CAST(SUM(node_id) AS BIGINT) AS ids, COUNT(t_natural) AS tagged, CAST(FLOOR(SUM(lat) * 1e6 + 0.5) AS BIGINT) AS content FROM node
 UNION ALL SELECT 'way', COUNT(*), CAST(SUM(way_id) AS BIGINT), COUNT(t_natural), (SELECT CAST(SUM(seq * node_id) AS BIGINT) FROM way_node JOIN way USING (way_id)) FROM way
 UNION ALL SELECT 'relation', COUNT(DISTINCT rel_id), (SELECT CAST(SUM(rel_id) AS BIGINT) FROM (SELECT DISTINCT rel_id FROM m)), 0, CAST(SUM((seq + 1) * ref) AS BIGINT) FROM m
 UNION ALL SELECT 'bounds', 1, 0, 0, 3""", "node way way_node")
def read_osm(v):
    """All elements written as one XML extract and read back."""
    path = scratch(v, "extract") + ".osm"
    tags = F.transform(F.map_entries("tags"), lambda e: F.struct(e.key.alias("_k"), e.value.alias("_v"))).alias("tag")
    refs = v.way_node.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("r"))  # an order has at most seven
    rows = {
        "node": v.nodes.select(F.col("node_id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), tags),
        "way": v.ways.join(refs, "way_id", "left").select(F.col("way_id").alias("_id"), F.transform("r", lambda r: F.struct(r.node_id.alias("_ref"))).alias("nd"), tags),
        "relation": members(v).groupBy("rel_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "ref", "role"))).alias("r")).select(
            F.col("rel_id").alias("_id"), F.transform("r", lambda m: F.struct(m.type.alias("_type"), m.ref.alias("_ref"), m.role.alias("_role"))).alias("member")),
        "bounds": v.spark.createDataFrame([(0.0, 0.0, 1.0, 2.0)], "_minlat double, _minlon double, _maxlat double, _maxlon double"),
    }
    for tag, df in rows.items():
        df.write.format("xml").option("rootTag", "osm").option("rowTag", tag).mode("append").save(path)
    back = O.read_osm(v.spark, path)
    total = lambda kind, df, key, content, tagged: df.agg(
        F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(F.col(key).cast("long")).alias("ids"), F.count(tagged).alias("tagged"), F.sum(content).cast("long").alias("content"))
    natural = F.try_element_at("tags", F.lit("natural"))
    walk = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0).cast("long"), lambda a, x: a + x)
    nodes = total("node", back["nodes"], "node_id", F.round(F.col("lat") * 1e6), natural)
    ways = total("way", back["ways"], "way_id", walk("refs", lambda r, i: i * r.cast("long")), natural)
    relations = total("relation", back["relations"], "rel_id", walk("members", lambda m, i: (i + 1) * m.ref.cast("long")), natural)
    box = back["bounds"].select(F.lit("bounds").alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("ids"), F.lit(0).cast("long").alias("tagged"),
                                F.col("south").cast("long") + F.col("west").cast("long") + F.col("north").cast("long") + F.col("east").cast("long"))
    return nodes.unionByName(ways).unionByName(relations).union(box)
