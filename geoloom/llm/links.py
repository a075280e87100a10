"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links a, b (long): equal roots for connected nodes.

    Each round joins every node to the neighbour of smallest hash, itself included, and keeps the links
    between different images. Hashes change with the round, so a constant share of the nodes goes in each
    round whatever the order of the ids, long chains included. Nothing leaves the executors.
    """
    links = settle(edges.select("a", "b").where("a <> b").distinct())
    maps = []
    while not links.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))), F.col(c).alias("id"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        image = settle(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["id"].alias("to")))
        maps.append(image)
        links = settle(links.join(image, "a").select("b", F.col("to").alias("x"))
                       .join(image.select(F.col("a").alias("b"), "to"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
                       .where("a <> b").distinct())
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for image in maps[1:]:
        step = image.select(F.col("a").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
