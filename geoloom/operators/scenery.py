"""Vegetation, ground faces, objects, buildings and place names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions import tags as T
from geoloom.functions.geo import dist, on_map
from geoloom.operators import polygons as G
from geoloom.operators.ordered import first_rows
from geoloom.session import settle, spread as deal


def surface_faces(edges: DataFrame, keys: list[str], width: float, height: float):
    """Filled ground faces on the map: (faces, collapsed count, polygons that cannot be filled)."""
    faces, odd = G.triangulate(edges, keys)
    kept, lost = G.drop_collapsed_faces(G.clip_polygons(faces, width, height))
    return kept, lost, odd


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the values, so any task makes the same choice."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def scatter_points(edges: DataFrame, areas: DataFrame, area: str, width: float, height: float, jitter: float,
                   seed: str = "") -> DataFrame:
    """Jittered lattice points inside areas, holes left empty: area, i, j, x, y, species, rotation.

    ``areas`` carries the area key, step and species (array). One hash per lattice cell replaces a running
    random stream, so areas and rows are independent.
    """
    box = edges.groupBy(area).agg(
        F.greatest(F.lit(-width / 2), F.min(F.least("x0", "x1"))).alias("minx"), F.least(F.lit(width / 2), F.max(F.greatest("x0", "x1"))).alias("maxx"),
        F.greatest(F.lit(-height / 2), F.min(F.least("y0", "y1"))).alias("miny"), F.least(F.lit(height / 2), F.max(F.greatest("y0", "y1"))).alias("maxy"))
    rows = box.join(areas.select(area, "step", "species"), area)
    count = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / F.col("step") - 0.5).cast("int")
    span = lambda lo, hi: F.explode(F.when(count(lo, hi) >= 1, F.sequence(F.lit(0), count(lo, hi) - 1)))
    # The rows of an area are dealt out before each of them becomes its cells.
    grid = deal(rows.withColumn("j", span("miny", "maxy")), [area, "j"]).withColumn("i", span("minx", "maxx"))
    draw = lambda what: unit_hash(F.lit(seed), F.col(area), F.col("i"), F.col("j"), F.lit(what))
    move = lambda what: (draw(what) * 2 - 1) * F.col("step") * jitter
    spots = grid.select(
        area, "i", "j", (F.col("minx") + F.col("step") * (F.col("i") + 0.5) + move("x")).alias("x"),
        (F.col("miny") + F.col("step") * (F.col("j") + 0.5) + move("y")).alias("y"),
        F.get("species", F.floor(draw("s") * F.size("species")).cast("int")).alias("species"),
        (draw("r") * 6.283185307179586).alias("rotation")).where(on_map("x", "y", width, height))
    return keep_inside(spots, edges, area, [area, "i", "j"])


def keep_inside(points: DataFrame, edges: DataFrame, area: str, ids: list[str], slab: float = 16.0) -> DataFrame:
    """Points that lie inside the polygon they are already paired with."""
    rows = points.withColumn("_slab", F.floor(F.col("y") / slab).cast("long"))
    low, high = F.floor(F.least("y0", "y1") / slab).cast("long"), F.floor(F.greatest("y0", "y1") / slab).cast("long")
    sides = edges.where("y0 <> y1").select(area, F.explode(F.sequence(low, high)).alias("_slab"), "x0", "y0", "x1", "y1")
    x_at = F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    hit = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))) & (F.col("x") < x_at)
    rest = [c for c in points.columns if c not in ids]
    found = rows.join(sides, [area, "_slab"]).where(hit).groupBy(*ids).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    return found.where("_n % 2 = 1").select(*points.columns)


def cap_items(items: DataFrame, order: list, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, left out): the first ``limit`` items in area, row and column order; without a limit all are kept."""
    if limit is None:
        return items, items.limit(0)
    return first_rows(items, order, limit)


def place_objects(nodes: DataFrame, position: DataFrame, width: float, height: float) -> DataFrame:
    """Point objects on the map, by node tags."""
    kinds = nodes.select("node_id", T.point_object_kind("tags").alias("kind"), "tags").where("kind IS NOT NULL")
    return (kinds.join(position, "node_id").where(on_map("x", "y", width, height))
            .withColumn("category", F.when(F.col("kind") == "tree", "vegetation").otherwise("objects")))


def mapped_nodes(nodes: DataFrame, position: DataFrame, width: float, height: float) -> DataFrame:
    """Street furniture and buildings mapped as nodes."""
    kinds = nodes.select("node_id", T.object_kind("tags").alias("kind"), T.is_building("tags").alias("building"),
                         T.building_height_m("tags").alias("tagged")).where("kind IS NOT NULL")
    return kinds.join(position, "node_id").where(on_map("x", "y", width, height)).select(
        "node_id", "x", "y", "kind", F.when(F.col("building"), "buildings").otherwise("mappedObjects").alias("category"),
        F.when(F.col("building"), F.col("tagged")).alias("height"))


def map_buildings(tagged: DataFrame, edges: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """Outlines fully on the map as aligned boxes with kind, category and explicit height.

    ``tagged`` carries keys and tags; ``edges`` the single closed outline of each key.
    """
    kinds = tagged.select(*keys, "tags", T.object_kind("tags").alias("kind"), T.is_building("tags").alias("building"),
                          T.building_height_m("tags").alias("tagged"), T.place_kind("tags").alias("place"))
    kinds = kinds.where("kind IS NOT NULL OR place IS NOT NULL")
    sides = edges.join(kinds.select(*keys), keys, "left_semi")
    off = sides.where(~on_map("x0", "y0", width, height)).select(*keys).distinct()
    boxes = G.footprint_box(sides.join(off, keys, "left_anti"), keys)
    return boxes.join(kinds, keys).withColumns({
        "category": F.when(F.col("building"), "buildings").otherwise("mappedObjects"),
        "height": F.when(F.col("building"), F.col("tagged"))}).drop("tagged", "building")


def unavailable_tags(tagged: DataFrame) -> DataFrame:
    """Counts of tags that make nothing: tag, n."""
    rows = tagged.where(T.object_kind("tags").isNull()).select(F.explode(T.unavailable_tag("tags")).alias("tag"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def dedupe_places(labels: DataFrame, apart: float = 300.0) -> DataFrame:
    """Keep a label unless a kept one of the same name and lower rank lies closer than ``apart``.

    Greedy by rank, in rounds. Cells are so small that two labels of one name in a cell exclude each
    other, so only the best label of each cell can be kept next; it is kept when no neighbouring cell
    holds a better one. A round compares cells with cells, and labels with at most one kept per cell, so
    a name with a third of all labels costs no more than its labels. Labels without a name share the name null.
    """
    side = apart / 1.5
    reach = 2
    plain, labels = labels, labels.withColumns({"_name": F.col("name"), "name": F.coalesce(F.concat(F.lit("="), F.col("name").cast("string")), F.lit(""))})
    open_ = settle(labels.withColumns({"_i": F.floor(F.col("x") / side).cast("long"), "_j": F.floor(F.col("y") / side).cast("long")}))
    around = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    spread = lambda df, cols: df.select("name", *cols, F.explode(F.array(*around)).alias("_o"), "_i", "_j").select(
        "name", *cols, (F.col("_i") + F.col("_o.a")).alias("_i"), (F.col("_j") + F.col("_o.b")).alias("_j"))
    kept = None
    while not open_.isEmpty():
        best = open_.groupBy("name", "_i", "_j").agg(F.min("rank").alias("best"))
        rival = spread(best, ["best"]).groupBy("name", "_i", "_j").agg(F.min("best").alias("lowest"))
        winners = best.join(rival, ["name", "_i", "_j"]).where("best = lowest").select("name", F.col("best").alias("rank"))
        round_ = settle(open_.join(winners, ["name", "rank"]))
        kept = round_ if kept is None else kept.unionByName(round_)
        near = spread(round_.select("name", F.col("x").alias("kx"), F.col("y").alias("ky"), "_i", "_j"), ["kx", "ky"])
        gone = (open_.select("name", "rank", "x", "y", "_i", "_j").join(near, ["name", "_i", "_j"])
                .where(dist("x", "y", "kx", "ky") < apart).select("name", "rank").distinct())
        open_ = settle(open_.join(gone, ["name", "rank"], "left_anti"))
    return plain.limit(0) if kept is None else kept.withColumn("name", F.col("_name")).select(*plain.columns)


def union_features(**stages: DataFrame) -> DataFrame:
    """One scenery table from the branches, with stage order kept as a column."""
    out = None
    for number, (name, df) in enumerate(stages.items()):
        part = df.withColumns({"stage": F.lit(number), "branch": F.lit(name)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


BEST = "struct<name:string,tier:int,swapped:boolean,score:double,cx:double,cy:double>"
RINGS = (0.7, 2.8, None)  # how far sizes may lie apart, as logarithms, in each round; the last has no end


def _order(m: str) -> Column:
    return F.struct(f"{m}.tier", f"{m}.score", f"{m}.name", f"{m}.swapped")


def ring_search(open_: DataFrame, models: DataFrame, axes: list[tuple[str, str, bool]], score: Column, fits: Column, bound) -> DataFrame:
    """(sig, found): the best model of every signature, searched outward from its size.

    ``axes`` pair a coordinate of the signature with the model's and say whether models above it count too. A round joins on grid cells as wide
    as its ring, so a signature asks two or three cells an axis whatever the round, weighs only models that lie in this ring and in no
    earlier one and that would beat its best so far, and leaves when ``bound`` of the ring, the least score beyond it, is worse than its best.
    Only models of the lowest tier that its classes have let it leave early.
    """
    done, earlier = None, F.lit(False)
    for ring in RINGS:
        asked, keyed, on = open_.select("*", F.explode("ckinds").alias("ckind")), models, ["ckind"]
        inside = F.lit(True)
        if ring is not None:
            for n, (own, other, both) in enumerate(axes):
                cell = lambda c: F.floor(c / ring).cast("long")  # noqa: E731, B023
                far = F.col(own) + (ring if both else 0.0)
                asked = asked.withColumn(f"_c{n}", F.explode(F.sequence(cell(F.col(own) - ring), cell(far))))
                keyed = keyed.withColumn(f"_c{n}", cell(F.col(other)))
                inside = inside & (F.col(other) > F.col(own) - ring) & (F.col(other) <= far)
                on.append(f"_c{n}")
        pairs = asked.join(keyed, on).where(inside & ~earlier).withColumn("score", F.round(score, 9))  # nine decimals tie alike everywhere and go by name
        pairs = pairs.withColumn("m", F.struct("name", "tier", "swapped", "score", "cx", "cy")).where(F.col("found").isNull() | (_order("m") < _order("found")))
        best = pairs.where(fits).groupBy("sig").agg(F.min_by("m", _order("m")).alias("m"))
        leaves = F.lit(True)
        if ring is not None:
            leaves = F.coalesce((F.col("found.tier") <= F.col("lowest")) & (F.col("found.score") < bound(ring) - 1e-6), F.lit(False))
        after = settle(open_.join(best, "sig", "left").withColumn("found", F.coalesce("m", "found")).drop("m").withColumn("_leaves", leaves))
        rest, left = after.where("_leaves").select("sig", "found"), after.where("NOT _leaves").drop("_leaves")
        done = rest if done is None else done.unionByName(rest)
        if ring is None or left.isEmpty():
            return done
        open_, earlier = left, inside
    return done


def match_candidates(objects: DataFrame, candidates: DataFrame, tiers: int | None = None, curated: dict[str, str] | None = None) -> DataFrame:
    """Best fitting candidate per object: tier first, then score, name and orientation.

    Objects carry item_id, kind, height, width and length (null without footprint) and shape (footprint
    around the object's position and along its axis). Equal objects are matched once, and of candidates of one size the first name counts.
    Footprints search a grid of sizes ring after ring, objects without footprint a grid of heights; an outline into which its whole
    box fits takes any smaller box without a test. With ``tiers`` only candidates of
    lower tiers are taken. ``curated`` names the candidate that an object without footprint should get, by kind. Objects
    with x, y and rotation also get px, py and turn: where the candidate's origin goes, so that its centre is on the object.
    """
    if tiers is not None:
        candidates = candidates.where(F.col("tier") < tiers)
    sig = ["kind", "height", "width", "length", "shape"]
    accepts = F.when(F.col("kind") == "building", F.array(F.lit("residential"), F.lit("commercial"), F.lit("industrial"))).otherwise(F.array("kind"))
    names = {k: n for k, n in (curated or {}).items()}
    known = F.col("name").isin(*names.values()) if names else F.lit(False)
    models = settle(candidates.groupBy(F.col("tier").cast("int").alias("tier"), F.col("kind").alias("ckind"), F.col("width").alias("cw"), F.col("length").alias("cl"),
                                       F.col("height").alias("ch"), known.alias("known"))
                    .agg(F.min(F.struct("name", "cx", "cy")).alias("m")).select("tier", "ckind", "cw", "cl", "ch", "known", "m.*"))
    lowest = models.groupBy("ckind").agg(F.min("tier").alias("tier"))
    wanted = objects.select(*sig).distinct().withColumn("sig", F.sha2(F.to_json(F.struct(*sig)), 256)).withColumn("ckinds", accepts)
    low = wanted.select("sig", F.explode("ckinds").alias("ckind")).join(lowest, "ckind").groupBy("sig").agg(F.min("tier").alias("lowest"))
    box = F.col("shape").isNull() | G.upright_box_in_face(F.col("width"), F.col("length"), F.col("shape"))
    # Signatures whose classes have no candidate end here.
    wanted = settle(wanted.join(low, "sig").withColumns({
        "u": F.log(F.col("width") + 0.01), "v": F.log(F.col("length") + 0.01), "t": F.when(F.col("height") > 0, F.log("height")), "roomy": box}))
    tall = F.when(F.col("t").isNotNull() & (F.col("ch") > 0), 0.25 * F.abs(F.log("ch") - F.col("t"))).otherwise(0.0)

    both = models.withColumn("swapped", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns({
        "w": F.when(F.col("swapped"), F.col("cl")).otherwise(F.col("cw")), "l": F.when(F.col("swapped"), F.col("cw")).otherwise(F.col("cl"))})
    sized = both.drop("cw", "cl", "known").withColumns({"x": F.log("w"), "y": F.log("l")}).where("x IS NOT NULL AND y IS NOT NULL")
    width, length, w, l = (F.col(c) for c in ("width", "length", "w", "l"))
    room = (w <= width + 0.01) & (l <= length + 0.01)
    held = room & ((F.col("roomy") & (w <= width) & (l <= length)) | F.col("shape").isNull() | G.upright_box_in_face(w, l, F.col("shape")))
    slack = F.greatest(F.col("u") - F.log(width), F.col("v") - F.log(length))
    outlined = ring_search(wanted.where("width IS NOT NULL").withColumn("found", F.lit(None).cast(BEST)), settle(sized), [("u", "x", False), ("v", "y", False)],
                           F.abs(F.log(w / width)) + F.abs(F.log(l / length)) + tall, held, lambda ring: ring - slack)

    # Without footprint only heights tell candidates apart: first those that no height or a wished name decides, then the nearest heights.
    wish = F.create_map(*[F.lit(x) for pair in {"": "", **names}.items() for x in pair])[F.col("kind")]
    plain = F.when(F.col("name") == wish, 0.0).otherwise(1.0)
    heights = models.withColumn("swapped", F.lit(False)).groupBy("tier", "ckind", "ch", "known", "swapped").agg(F.min(F.struct("name", "cx", "cy")).alias("m")).select("tier", "ckind", "ch", "known", "swapped", "m.*")
    heights = settle(heights.withColumn("x", F.when(F.col("ch") > 0, F.log("ch"))))
    bare = wanted.where("width IS NULL")
    first = heights.groupBy("ckind", "tier").agg(F.min(F.struct("name", "cx", "cy")).alias("m"), F.min(F.when(F.col("x").isNull(), F.struct("name", "cx", "cy"))).alias("flat"))
    pick = lambda m: F.struct(m["name"].alias("name"), F.col("tier"), F.lit(False).alias("swapped"), F.lit(1.0).alias("score"), m["cx"].alias("cx"), m["cy"].alias("cy"))
    asked = bare.select("sig", "kind", "t", F.explode("ckinds").alias("ckind"))
    start = asked.join(first, "ckind").withColumn("p", F.when(F.col("t").isNull(), pick(F.col("m"))).when(F.col("flat").isNotNull(), pick(F.col("flat")))).select("sig", "p")
    wished = asked.join(heights.where("known"), "ckind").select("sig", F.struct("name", "tier", "swapped", F.round(plain + tall, 9).alias("score"), "cx", "cy").alias("p"))
    found = start.where("p IS NOT NULL").unionByName(wished).groupBy("sig").agg(F.min_by(F.col("p").cast(BEST), _order("p")).alias("found"))
    bare = settle(bare.join(found, "sig", "left"))
    near = ring_search(bare.where("t IS NOT NULL"), heights.where("x IS NOT NULL"), [("t", "x", True)], plain + tall, F.lit(True), lambda ring: 1 + 0.25 * ring)
    best = outlined.unionByName(near).unionByName(bare.where("t IS NULL").select("sig", "found")).select("sig", F.col("found").alias("m"))
    keyed = objects.withColumn("sig", F.sha2(F.to_json(F.struct(*sig)), 256))
    turn = F.col("rotation") + F.when(F.col("m.swapped"), F.lit(math.pi / 2)).otherwise(0.0)
    spot = [] if not {"x", "y", "rotation"} <= set(objects.columns) else [
        (F.col("x") - F.col("m.cx") * F.cos(turn) + F.col("m.cy") * F.sin(turn)).alias("px"),
        (F.col("y") - F.col("m.cx") * F.sin(turn) - F.col("m.cy") * F.cos(turn)).alias("py"), F.when(F.col("m").isNotNull(), turn).alias("turn")]
    return keyed.join(best, "sig", "left").select(
        *spot,
        "item_id", "kind", F.col("m.name").alias("name"), F.col("m.tier").alias("tier"), F.col("m.swapped").alias("swapped"),
        F.col("m.score").alias("score"), F.col("m.cx").alias("cx"), F.col("m.cy").alias("cy"), F.col("m").isNull().alias("unmatched"))


def match_summary(matches: DataFrame, examples: int) -> tuple[DataFrame, DataFrame]:
    """Counts by outcome, and the first ``examples`` distinct labels."""
    counts = matches.agg(F.count(F.when(F.col("tier") == 0, 1)).alias("tier0"), F.count(F.when(F.col("tier") > 0, 1)).alias("tier1"),
                         F.count(F.when(F.col("unmatched"), 1)).alias("unmatched"))
    label = F.concat_ws(": ", "kind", F.coalesce("name", F.lit("no fitting candidate")))
    return counts, first_rows(matches.select(label.alias("label")).distinct(), ["label"], examples)[0]


def uncovered_ways(ways: DataFrame, members: DataFrame, roles: tuple[str, ...] | None = None, closed: DataFrame | None = None) -> DataFrame:
    """Ways that no relation of ``members`` draws already.

    With ``roles`` only members in one of these roles cover their way (a missing role is the empty one), and with ``closed`` (way_id) only closed
    ways are covered, as an open one may be drawn as a line beside the area it bounds.
    """
    drawn = members.where("type = 'way'")
    if roles is not None:
        drawn = drawn.where(F.coalesce("role", F.lit("")).isin(*roles))
    drawn = drawn.select(F.col("ref").alias("way_id"))
    if closed is not None:
        drawn = drawn.join(closed.select("way_id"), "way_id", "left_semi")
    return ways.join(drawn, "way_id", "left_anti")


def closed_way_areas(ways: DataFrame, totals: DataFrame, kind: Column, covered: DataFrame) -> DataFrame:
    """Closed ways of at least four references with a kind, unless an accepted relation draws them already."""
    chosen = ways.select("way_id", "tags", kind.alias("kind")).where("kind IS NOT NULL")
    whole = totals.where((F.col("n") > 3) & (F.col("first_node") == F.col("last_node")))
    return chosen.join(whole, "way_id").join(covered.select("way_id"), "way_id", "left_anti")


def resolve_items(items: DataFrame, saved: DataFrame) -> DataFrame:
    """Items with their saved match: a match replaces the item's own model, an unmatched one drops it.

    ``items`` has item_id, kind, model, x, y, rotation; ``saved`` item_id, m_model, m_x, m_y, m_rotation, m_unmatched.
    """
    rows = items.join(saved, "item_id", "left")
    free = F.col("kind").isNull()
    told = ~free & F.col("m_unmatched").isNotNull()
    keep = free | (told & ~F.coalesce("m_unmatched", F.lit(False))) | (~told & F.col("model").isNotNull())
    pick = lambda c: F.when(told, F.col("m_" + c)).otherwise(F.col(c)).alias(c)
    return rows.where(keep).select("item_id", "kind", pick("model"), pick("x"), pick("y"), pick("rotation"))


def area_edges(ways: DataFrame, relations: DataFrame, members: DataFrame, way_node: DataFrame, position: DataFrame, kind):
    """Polygons of one rule from relations and closed ways: (edges, areas, issues).

    ``kind`` maps a tags column name to a Column. Edges carry area, ring, idx and their ends; areas carry
    area, kind, tags. Outer ways of an accepted relation make no area of their own.
    """
    from geoloom.operators import graph
    from geoloom.operators.networks import way_totals

    way_node = way_node.select("way_id", "seq", "node_id")
    wanted = relations.where(T.same(T.tag("tags", "type"), "multipolygon")).select("rel_id", "tags", kind("tags").alias("kind")).where("kind IS NOT NULL")
    tree, broken = graph.multipolygon_tree(wanted.select("rel_id"), members, relations, ways)
    tree = settle(tree)
    rings, bad = G.assemble_rings(graph.member_order(tree), way_node, ["root", "role"])
    rings = settle(rings)
    missing = rings.join(position.select("node_id"), "node_id", "left_anti").select("root").distinct()
    hollow = tree.select("root").distinct().join(rings.where("role = 'outer'").select("root").distinct(), "root", "left_anti")
    issues = (broken.select("root", "reason").unionByName(bad.select("root", "reason"))
              .unionByName(hollow.select("root", F.lit("no outer ring").alias("reason"))))
    issues = settle(issues.unionByName(missing.select("root", F.lit("missing node").alias("reason"))).groupBy("root").agg(F.min("reason").alias("reason")))
    covered = tree.where("role = 'outer'").join(issues.where("reason <> 'missing node'").select("root"), "root", "left_anti").select("way_id").distinct()
    own = settle(closed_way_areas(ways, way_totals(way_node), kind("tags"), covered))
    inner = (F.col("role") == "inner").cast("int")
    from_rel = rings.join(issues.select("root"), "root", "left_anti").select(
        F.concat(F.lit("relation:"), F.col("root").cast("string")).alias("area"), (F.col("ring") * 2 + inner).alias("ring"), "idx", "n", "node_id")
    from_way = way_node.join(own.select("way_id", F.col("n").alias("_n")), "way_id").where(F.col("seq") < F.col("_n") - 1).select(
        F.concat(F.lit("way:"), F.col("way_id").cast("string")).alias("area"), F.lit(0).cast("long").alias("ring"), F.col("seq").cast("long").alias("idx"),
        (F.col("_n") - 1).alias("n"), "node_id")
    placed = settle(from_rel.unionByName(from_way).join(position, "node_id", "left"))
    lost = placed.where("x IS NULL").select("area").distinct()
    edges = settle(G.ring_edges(placed.join(lost, "area", "left_anti"), ["area", "ring"]))
    areas = (wanted.select(F.concat(F.lit("relation:"), F.col("rel_id").cast("string")).alias("area"), "kind", "tags")
             .unionByName(own.select(F.concat(F.lit("way:"), F.col("way_id").cast("string")).alias("area"), "kind", "tags")))
    found = edges.select("area").distinct()
    notes = issues.select(F.concat(F.lit("relation:"), F.col("root").cast("string")).alias("area"), "reason").unionByName(
        lost.select("area", F.lit("missing node").alias("reason")))
    return edges, areas.join(found, "area", "left_semi"), notes.distinct()
