"""Boxes cut into parts and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.functions import geo as G
from geoloom.session import settle

PART_M = 8000.0


def covering_tiles(boxes: DataFrame, zoom: int) -> DataFrame:
    """Slippy tiles (tx, ty) that meet each box, clipped to the world."""
    last = 2 ** zoom - 1
    x0, y0 = G.tile_pixel("north", "west", zoom)
    x1, y1 = G.tile_pixel("south", "east", zoom)
    tile = lambda p: F.floor(p / 256).cast("long")
    span = lambda a, b: F.sequence(F.greatest(F.lit(0), tile(a)), F.least(F.lit(last), tile(b)))
    return boxes.withColumn("tx", F.explode(span(x0, x1))).withColumn("ty", F.explode(span(y0, y1)))


def partition_bbox(boxes: DataFrame, keys: list[str], part_m: float = PART_M, most: int | None = None) -> DataFrame:
    """Cut each box into equal parts of at most ``part_m`` on the ground; neighbours share their edges.

    With ``most`` a box that needs more parts is an error.
    """
    w, h = G.ground_extent("south", "west", "north", "east")
    rows = boxes.withColumns({"nx": F.greatest(F.lit(1), F.ceil(w / part_m).cast("int")),
                              "ny": F.greatest(F.lit(1), F.ceil(h / part_m).cast("int"))})
    if most is not None:
        rows = rows.where(F.assert_true(F.col("nx") * F.col("ny") <= most, F.lit("box needs too many parts")).isNull())
    cells = (rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))))
    lat = lambda k: F.when(k == F.col("ny"), F.col("north")).otherwise(
        F.col("south") + (F.col("north") - F.col("south")) * k / F.col("ny"))
    lon = lambda k: F.when(k == F.col("nx"), F.col("east")).otherwise(
        F.col("west") + (F.col("east") - F.col("west")) * k / F.col("nx"))
    i, j = F.col("i"), F.col("j")
    return cells.select(*keys, "i", "j", lat(j).alias("south"), lon(i).alias("west"), lat(j + 1).alias("north"),
                        lon(i + 1).alias("east"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], by: tuple = (), at: tuple = ("lat", "lon"),
                    corners: tuple = ("south", "west", "north", "east")) -> DataFrame:
    """Pairs of a point and the half-open boxes that hold it: all columns of the point, and the keys of the box.

    ``by`` are columns of both sides that must agree, ``at`` the point's two coordinates, ``corners`` the box's lower two and upper two.

    A box lies in at most four cells of the power of two that its longer side does not exceed. Points are placed in
    the cells of the sizes that occur, of which there are only as many as binary orders of magnitude.
    """
    (u, v), (u0, v0, u1, v1) = at, corners
    side = F.greatest(F.col(u1) - F.col(u0), F.col(v1) - F.col(v0), F.lit(2.0 ** -40))
    cell = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")
    span = lambda a, b: F.sequence(cell(a, F.col("_lv")), cell(b, F.col("_lv")))
    placed = (boxes.select(*by, *keys, *[F.col(c).alias(f"_{i}") for i, c in enumerate(corners)], F.ceil(F.log2(side)).cast("int").alias("_lv"))
              .withColumn("_ci", F.explode(span("_0", "_2"))).withColumn("_cj", F.explode(span("_1", "_3"))))
    levels = sorted(r[0] for r in placed.select("_lv").distinct().collect())  # at most 50 sizes
    if not levels:
        levels = [0]
    spots = points.withColumn("_lv", F.explode(F.array(*[F.lit(v).cast("int") for v in levels])))
    spots = spots.withColumn("_ci", cell(u, F.col("_lv"))).withColumn("_cj", cell(v, F.col("_lv")))
    inside = (F.col(u) >= F.col("_0")) & (F.col(u) < F.col("_2")) & (F.col(v) >= F.col("_1")) & (F.col(v) < F.col("_3"))
    return spots.join(placed, [*by, "_lv", "_ci", "_cj"]).where(inside).select(*points.columns, *keys)


def split_dense_parts(points: DataFrame, boxes: DataFrame, keys: list[str], limit: int, smallest_m: float = 1000.0) -> DataFrame:
    """Halve boxes along their longer ground side until none holds more than ``limit`` points: keys, part, rows, corners.

    A point belongs to every box, and to the one half-open part of it, that it lies in; ``part`` is the path of halves,
    from 'p'. A round counts points per open part and sends the points of the dense ones down one half, so a crowded
    corner is split again and again. Boxes with the same corners are split once, and points at one place are counted before, so
    the rounds grow with the different boxes and places. Boxes need distinct keys.
    """
    corners = ["south", "west", "north", "east"]
    named, keys, shape = keys, ["_shape"], settle(boxes.select(*corners).distinct().withColumn("_shape", F.monotonically_increasing_id()))
    parts = settle(shape.select("_shape", F.lit("p").alias("part"), *corners))
    spots = settle(points.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("_w")))
    member = settle(points_in_boxes(spots, parts, keys).withColumn("part", F.lit("p")))
    done = None
    while True:
        counts = member.groupBy(*keys, "part").agg(F.sum("_w").alias("rows"))
        sized = parts.join(counts, [*keys, "part"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
        w, h = G.ground_extent("south", "west", "north", "east")
        sized = settle(sized.withColumns({"wide": w >= h, "open": (F.col("rows") > limit) & (F.greatest(w, h) > smallest_m)}))
        closed = sized.where(~F.col("open")).select(*keys, "part", "rows", "south", "west", "north", "east")
        done = closed if done is None else done.unionByName(closed)
        dense = sized.where("open")
        if dense.isEmpty():
            found = done.select("_shape", "part", "rows", *[F.col(c).alias("_" + c) for c in corners])
            back = boxes.select(*named, *corners).join(shape, corners).drop(*corners).join(found, "_shape")
            return back.select(*named, "part", "rows", *[F.col("_" + c).alias(c) for c in corners])
        mid_lat, mid_lon = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
        wide = F.col("wide")
        halves = F.array(
            F.struct(F.concat("part", F.lit("0")).alias("part"), F.col("south").alias("south"), F.col("west").alias("west"),
                     F.when(wide, F.col("north")).otherwise(mid_lat).alias("north"),
                     F.when(wide, mid_lon).otherwise(F.col("east")).alias("east")),
            F.struct(F.concat("part", F.lit("1")).alias("part"), F.when(wide, F.col("south")).otherwise(mid_lat).alias("south"),
                     F.when(wide, mid_lon).otherwise(F.col("west")).alias("west"), F.col("north").alias("north"),
                     F.col("east").alias("east")))
        upper = F.when(wide, F.col("lon") >= mid_lon).otherwise(F.col("lat") >= mid_lat)
        member = settle(member.join(dense, [*keys, "part"]).select(
            *keys, "lat", "lon", "_w", F.concat("part", F.when(upper, "1").otherwise("0")).alias("part")))
        parts = settle(dense.select(*keys, F.inline(halves)))


def source_plan(boxes: DataFrame, most: int | None = None) -> DataFrame:
    """One-degree elevation tiles each box needs, after widening for interpolation."""
    south, west, north, east = G.expand_box("south", "west", "north", "east")
    count = lambda a, b: F.sequence(F.floor(a).cast("int"), (F.ceil(b) - 1).cast("int"))
    rows = boxes.withColumns({"_lats": count(south, north), "_lons": count(west, east)})
    if most is not None:
        rows = rows.where(F.assert_true(F.size("_lats") * F.size("_lons") <= most, F.lit("too many source tiles")).isNull())
    rows = rows.withColumn("lat0", F.explode("_lats")).withColumn("lon0", F.explode("_lons")).drop("_lats", "_lons")
    pad = lambda c, n: F.lpad(F.abs(F.col(c)).cast("string"), n, "0")
    return rows.withColumn("tile", F.concat(F.when(F.col("lat0") >= 0, "N").otherwise("S"), pad("lat0", 2),
                                            F.when(F.col("lon0") >= 0, "E").otherwise("W"), pad("lon0", 3)))
