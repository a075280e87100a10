"""Relation descent, closures and components, as rounds of joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.session import settle


def water_closure(seeds: DataFrame, members: DataFrame) -> DataFrame:
    """Containers (type, id) that hold a seed at any depth, and the seeds themselves.

    ``members`` are the rows rel_id, type, ref of the relations that may act as containers.
    """
    found = settle(seeds.select("type", "id").distinct())
    fresh = found
    while not fresh.isEmpty():
        up = (fresh.join(members.select("type", F.col("ref").alias("id"), "rel_id"), ["type", "id"])
              .select(F.lit("relation").alias("type"), F.col("rel_id").alias("id")).distinct())
        fresh = settle(up.join(found, ["type", "id"], "left_anti"))
        found = found.unionByName(fresh)
    return found


def reachable_entities(seeds: DataFrame, children: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Everything below the seeds, each once, and the references that exist nowhere.

    ``children`` are edges type, id, ctype, cid (ways to nodes, relations to members); ``known`` all
    existing (type, id).
    """
    seen = settle(seeds.select("type", "id").distinct())
    fresh = seen
    while not fresh.isEmpty():
        down = (fresh.join(children, ["type", "id"]).select(F.col("ctype").alias("type"), F.col("cid").alias("id")).distinct())
        fresh = settle(down.join(seen, ["type", "id"], "left_anti"))
        seen = seen.unionByName(fresh)
    present = seen.join(known.select("type", "id"), ["type", "id"], "left_semi")
    return present, seen.join(known.select("type", "id"), ["type", "id"], "left_anti")


def multipolygon_tree(roots: DataFrame, members: DataFrame, relations: DataFrame, ways: DataFrame,
                      deepest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Member ways of each root relation with their effective role, and the roots that fail.

    Below an inner relation outer and inner swap. A root fails on a cycle, a missing relation or a
    missing way, and where ``deepest`` is given on relations nested deeper than that. Returns ways (root, role, mseq, way_id), in depth-first member order, and issues
    (root, reason). ``members`` has rel_id, seq, type, ref, role.
    """
    role = F.when(F.coalesce("role", F.lit("")) == "", "outer").otherwise(F.col("role"))
    table = members.select("rel_id", "seq", "type", "ref", role.alias("role")).where("role IN ('outer', 'inner')")
    open_ = settle(roots.select(F.col("rel_id").alias("root"), "rel_id", F.lit("outer").alias("as_role"),
                                F.array(F.col("rel_id")).alias("path"), F.array().cast("array<long>").alias("place")))
    found, broken = None, None
    grow = lambda have, more: more if have is None else have.unionByName(more)
    depth = 0
    while True:
        depth += 1
        step = open_.join(table, "rel_id").select(
            "root", "type", "ref", "path", F.concat("place", F.array(F.col("seq").cast("long"))).alias("place"),
            F.when(F.col("as_role") == "outer", F.col("role")).otherwise(
                F.when(F.col("role") == "outer", "inner").otherwise("outer")).alias("role"))
        step = settle(step)
        found = grow(found, step.where("type = 'way'").select("root", "role", "place", F.col("ref").alias("way_id")))
        nested = step.where("type = 'relation'")
        loops = F.array_contains("path", F.col("ref"))
        broken = grow(broken, nested.where(loops).select("root", F.lit("cycle").alias("reason")))
        below = nested.where(~loops)
        lost = below.join(relations.select(F.col("rel_id").alias("ref")), "ref", "left_anti")
        broken = grow(broken, lost.select("root", F.lit("missing relation").alias("reason")))
        open_ = settle(below.join(relations.select(F.col("rel_id").alias("ref")), "ref", "left_semi").select(
            "root", F.col("ref").alias("rel_id"), F.col("role").alias("as_role"),
            F.concat("path", F.array("ref")).alias("path"), "place"))
        if open_.isEmpty():
            break
        if depth == deepest:
            broken = grow(broken, open_.select("root", F.lit("relations nest too deeply").alias("reason")))
            break
    broken = grow(broken, found.join(ways.select("way_id"), "way_id", "left_anti").select("root", F.lit("missing way").alias("reason")))
    issues = settle(broken.distinct())
    good = found.join(issues.select("root").distinct(), "root", "left_anti")
    return good, issues


def member_order(ways: DataFrame) -> DataFrame:
    """Number the member ways of each (root, role) by their place; mseq is what ring assembly expects."""
    from geoloom.operators.ordered import block_row_number

    ranked = block_row_number(ways, ["root", "role"], ["place", "way_id"], F.coalesce(F.get("place", F.lit(0)), F.lit(0)) / 4096, "mseq")
    return ranked.select("root", "role", (F.col("mseq") - 1).alias("mseq"), "way_id")


def components(edges: DataFrame) -> DataFrame:
    """Connected component of every node: node, label (smallest node in it). Edges are a, b.

    Each round joins every node with its neighbour of smallest hash, itself included, and keeps only the edges between
    different images, so finished components and inner edges leave the work. Hashes change with the round, so a constant share of
    the nodes goes in each, whatever the order of the ids. Minima combine before the shuffle, so hub nodes cost no more than their edges.
    """
    nodes = settle(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links, images = settle(edges.select("a", "b").where("a <> b").distinct()), []
    while not links.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(images))).alias("h"), F.col(c).alias("id"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        image = settle(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["id"].alias("to")))
        images.append(image)
        links = settle(links.join(image, "a").select("b", F.col("to").alias("x")).join(image.select(F.col("a").alias("b"), "to"), "b")
                       .where("x <> to").select(F.col("x").alias("a"), F.col("to").alias("b")).distinct())
    out = nodes.withColumn("root", F.col("node"))
    for image in images:
        out = out.join(image.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = settle(out)
    return out.join(out.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label")


def connected_groups(edges: DataFrame) -> DataFrame:
    return components(edges).agg(F.countDistinct("label").alias("groups"))
