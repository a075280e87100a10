"""Map extracts: reading, checking, merging and cutting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.functions.geo import finite, valid_position
from geoloom.operators.graph import reachable_entities
from geoloom.spec import Bounds

TAG = "tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
SCHEMAS = {
    "node": f"_id STRING, _lat DOUBLE, _lon DOUBLE, {TAG}",
    "way": f"_id STRING, nd ARRAY<STRUCT<_ref: STRING>>, {TAG}",
    "relation": f"_id STRING, member ARRAY<STRUCT<_type: STRING, _ref: STRING, _role: STRING>>, {TAG}",
    "bounds": "_minlat DOUBLE, _minlon DOUBLE, _maxlat DOUBLE, _maxlon DOUBLE",
}


VERSION = "0.6"  # fixed value: the version of the extract format

def _tags():
    entries = F.transform(F.coalesce("tag", F.array()), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))
    return F.map_from_entries(entries)


def read_osm(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """nodes, ways, relations and bounds of an XML extract, one pass per element.

    Reference order and duplicates are kept; of two equal tag keys, and of two entities of one kind with the same id, the
    last in the extract wins. Land the result as Parquet before heavy work.
    """
    if not path.rstrip("/").lower().endswith((".osm", ".xml", "*")):
        raise ValueError("use map XML ending in .osm or .xml")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    rows = {tag: spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST" if strict else "PERMISSIVE")
            .schema(schema).load(path) for tag, schema in SCHEMAS.items()}
    nodes = rows["node"].select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags().alias("tags"))
    if strict:
        if nodes.isEmpty():
            raise ValueError("the extract has no nodes")
        sound = F.assert_true(valid_position("lat", "lon"), F.concat(F.lit("bad coordinates at node "), F.coalesce("node_id", F.lit("?"))))
        nodes = nodes.where(sound.isNull())
    ways = rows["way"].select(F.col("_id").alias("way_id"), F.transform(F.coalesce("nd", F.array()), lambda n: n["_ref"]).alias("refs"), _tags().alias("tags"))
    relations = rows["relation"].select(
        F.col("_id").alias("rel_id"), F.transform(F.coalesce("member", F.array()), lambda m: F.struct(
            m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members"), _tags().alias("tags"))
    nodes, ways, relations = _last(nodes, "node_id"), _last(ways, "way_id"), _last(relations, "rel_id")
    bounds = rows["bounds"].select(F.col("_minlat").alias("south"), F.col("_minlon").alias("west"), F.col("_maxlat").alias("north"),
                                   F.col("_maxlon").alias("east"))
    return {"nodes": nodes, "ways": ways, "relations": relations, "bounds": bounds}


def _last(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each id, by place in the extract; rows without an id stay as they are."""
    whole = F.struct(*[c for c in rows.columns if c != key]).alias("_row")
    placed = rows.select(key, whole, F.monotonically_increasing_id().alias("_at"))
    last = placed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("_row", "_at").alias("_row"))
    return last.unionByName(placed.where(F.col(key).isNull()).drop("_at")).select(*[key if c == key else f"_row.{c}" for c in rows.columns])


def relation_members(relations: DataFrame) -> DataFrame:
    return relations.select("rel_id", F.posexplode("members").alias("seq", "m")).select("rel_id", "seq", "m.type", "m.ref", "m.role")


def validate_osm(nodes: DataFrame, ways: DataFrame, relations: DataFrame, notes: DataFrame | None = None,
                 formats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts per kind, rejects: kind, id, reason). ``notes`` holds service remarks (kind, text), ``formats`` the versions that files state (file, version)."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    where = finite("lat") & finite("lon") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    n = nodes.select(F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("id"),
                     F.when(blank("node_id"), "no id").when(~where, "bad coordinates").alias("reason"))
    w = ways.select(F.lit("way").alias("kind"), F.col("way_id").cast("string").alias("id"), F.when(blank("way_id"), "no id").when(F.size("refs") == 0, "no references")
                    .when(F.exists("refs", lambda x: x.isNull()), "a reference without a node").alias("reason")) if "refs" in ways.columns else ways.select(
        F.lit("way").alias("kind"), F.col("way_id").cast("string").alias("id"), F.when(blank("way_id"), "no id").alias("reason"))
    r = relations.select(F.lit("relation").alias("kind"), F.col("rel_id").cast("string").alias("id"), F.when(blank("rel_id"), "no id").when(
        F.exists("members", lambda m: m["ref"].isNull() | ~F.coalesce(m["type"], F.lit("")).isin("node", "way", "relation")), "a member without a target").alias("reason")) \
        if "members" in relations.columns else relations.select(F.lit("relation").alias("kind"), F.col("rel_id").cast("string").alias("id"), F.when(blank("rel_id"), "no id").alias("reason"))
    rows = n.unionByName(w).unionByName(r)
    rejects = rows.where("reason IS NOT NULL")
    if notes is not None:
        rejects = rejects.unionByName(notes.select("kind", F.lit(None).cast("string").alias("id"), F.concat(F.lit("service said: "), "text").alias("reason")))
    if formats is not None:
        wrong = formats.where(~F.coalesce(F.col("version").cast("string"), F.lit("")).isin(VERSION))
        rejects = rejects.unionByName(wrong.select(F.lit("file").alias("kind"), F.col("file").cast("string").alias("id"), F.lit("unsupported format version").alias("reason")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), rejects


def merge_osm_parts(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of neighbouring extracts: (unique entities, conflicts).

    Rows have part, kind, id, attrs (map) and children (ordered array). Attribute order is no content, so
    the signature sorts attributes. Copies of one entity combine before the shuffle; the same id with two
    signatures is a conflict. Unique entities keep their attrs and children.
    """
    attrs = F.array_sort(F.map_entries("attrs"))
    sig = F.sha2(F.to_json(F.struct(attrs.alias("a"), F.col("children").alias("c"))), 256)
    # As four whole numbers, signatures are compared in a hash table of fixed rows; as text they would be sorted in every task.
    words = [f"_s{i}" for i in range(4)]
    rows = entities.withColumn("_sig", sig).withColumns({w: F.conv(F.substring("_sig", 16 * i + 1, 16), 16, -10).cast("long") for i, w in enumerate(words)}).drop("_sig")
    out = rows.groupBy("kind", "id").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("attrs", "children")).alias("_body"),
                                         *[F.min(w).alias(w) for w in words], *[F.max(w).alias(w + "x") for w in words])
    conflict = reduce(lambda a, b: a | b, [F.col(w) != F.col(w + "x") for w in words])
    text = F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words]).alias("sig")
    whole = out.where(~conflict).select("kind", "id", "part", text, "copies", "_body.attrs", "_body.children")
    return whole, out.where(conflict).select("kind", "id")


def dataset_bounds(explicit: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: the given box, else the box of the nodes with inferred = true; two different boxes conflict."""
    given = explicit.agg(*[F.min(c).alias(c) for c in ("south", "west", "north", "east")],
                         F.countDistinct("south", "west", "north", "east").alias("boxes"))
    found = nodes.agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    both = given.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k")
    return both.select(F.coalesce("south", "s").alias("south"), F.coalesce("west", "w").alias("west"), F.coalesce("north", "n").alias("north"),
                       F.coalesce("east", "e").alias("east"), (F.col("boxes") == 0).alias("inferred"), (F.col("boxes") > 1).alias("conflict"))


def extract_area(nodes: DataFrame, way_node: DataFrame, members: DataFrame, known: DataFrame, box: Bounds) -> tuple[DataFrame, DataFrame]:
    """All entities that touch a box with everything below them, and references that exist nowhere."""
    inside = nodes.where(F.col("lat").between(box.south, box.north) & F.col("lon").between(box.west, box.east)).select("node_id")
    ways = way_node.join(inside, "node_id", "left_semi").select("way_id").distinct()
    seed = (inside.select(F.lit("node").alias("type"), F.col("node_id").alias("id"))
            .unionByName(ways.select(F.lit("way").alias("type"), F.col("way_id").alias("id"))))
    holders = members.select("rel_id", "type", F.col("ref").alias("id")).join(seed, ["type", "id"], "left_semi").select("rel_id").distinct()
    seed = seed.unionByName(holders.select(F.lit("relation").alias("type"), F.col("rel_id").alias("id")))
    children = way_node.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.lit("node").alias("ctype"), F.col("node_id").alias("cid")).unionByName(
        members.select(F.lit("relation").alias("type"), F.col("rel_id").alias("id"), F.col("type").alias("ctype"), F.col("ref").alias("cid")))
    return reachable_entities(seed, children, known)
