"""Whole jobs: an extract to a map dataset, and elevation sources to a finished height grid."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from geoloom.functions import tags as T
from geoloom.functions.geo import on_map, project_xy
from geoloom.operators import editing as E, networks as N, raster as R, scenery as S, water as W
from geoloom.session import prepare, settle
from geoloom.sources.osm import relation_members
from geoloom.spec import BiomeOptions, GridSpec, MapSpec, NetworkOptions, SceneryOptions


# Which switch turns a kind of point object off.
POINT_FEATURES = {"tree": "tree_nodes", "fountain": "fountains", "bollard": "bollards", "advertising_column": "advertising_columns"}


def convert_map(nodes: DataFrame, ways: DataFrame, relations: DataFrame, spec: MapSpec, network: NetworkOptions = NetworkOptions(),
                scenery: SceneryOptions = SceneryOptions()) -> dict[str, DataFrame]:
    """Tables of a map dataset: nodes, edges, scenery, labels, water, unavailable, issues."""
    prepare(nodes.sparkSession)
    w, h = spec.width, spec.height
    x, y = project_xy("lat", "lon", spec)
    nodes, ways, relations = settle(nodes), settle(ways), settle(relations)
    position = settle(nodes.select("node_id", x.alias("x"), y.alias("y")))
    way_node = settle(N.way_nodes(ways))
    members = settle(relation_members(relations))

    edges = settle(N.network_edges(ways, way_node, nodes, position, w, h, network))
    area, areas, notes = S.area_edges(ways, relations, members, way_node, position, T.surface_kind)
    areas = settle(areas)
    on = lambda *names: [n for n in names if scenery.features.get(n, True)]
    grown = [kind for kind, name in (("forest", "forests"), ("shrubs", "shrubs")) if on(name)]
    planted = areas.where(F.col("kind").isin(*grown, "")).select(
        "area", F.when(F.col("kind") == "shrubs", scenery.shrub_step).otherwise(scenery.forest_step).alias("step"),
        F.when(F.col("kind") == "shrubs", F.array(*[F.lit(s) for s in scenery.shrubs])).when(
            T.same(T.tag("tags", "leaf_type"), "needleleaved"), F.array(*[F.lit(s) for s in scenery.conifer])).otherwise(
            F.array(*[F.lit(s) for s in scenery.broadleaf])).alias("species"))
    trees = S.scatter_points(area.join(planted.select("area"), "area", "left_semi"), planted, "area", w, h, scenery.jitter, scenery.seed)
    trees = S.cap_items(trees, ["area", "j", "i"], scenery.max_trees)[0].select(
        F.lit("vegetation").alias("category"), F.col("species").alias("cls"), "x", "y", "rotation", F.col("area").alias("source"))
    paved = areas.where(F.lit(bool(on("surfaces"))) & ~F.col("kind").isin("forest", "shrubs")).select("area", F.col("kind").alias("cls"))
    faces, _, odd = S.surface_faces(area.join(paved, "area", "left_semi"), ["area"], w, h)
    faces = faces.join(paved, "area").select(F.lit("surfaces").alias("category"), "cls", "face", F.col("area").alias("source"))

    name = lambda t, c: F.concat(F.lit(t + ":"), F.col(c).cast("string"))
    dots = [kind for kind, name in POINT_FEATURES.items() if on(name)]
    points = S.place_objects(nodes, position, w, h).where(F.col("kind").isin(*dots, "")).select("category", F.col("kind").alias("cls"), "x", "y", F.lit(0.0).alias("rotation"),
                                                           F.col("kind").alias("match_kind"), name("node", "node_id").alias("source"))
    mapped = S.mapped_nodes(nodes, position, w, h).select("category", "x", "y", F.lit(0.0).alias("rotation"), F.col("kind").alias("match_kind"),
                                                          F.col("height").alias("match_height"), name("node", "node_id").alias("source"))
    outline = lambda tags: F.coalesce(T.object_kind(tags), T.tag(tags, "place"))
    sides, tagged, _ = S.area_edges(ways, relations, members, way_node, position, outline)
    single = sides.groupBy("area").agg(F.countDistinct("ring").alias("rings")).where("rings = 1")
    boxes = settle(S.map_buildings(tagged, sides.join(single.select("area"), "area", "left_semi"), ["area"], w, h))
    built = boxes.where("kind IS NOT NULL").select(
        "category", F.col("px").alias("x"), F.col("py").alias("y"), "rotation", F.col("kind").alias("match_kind"), F.col("height").alias("match_height"),
        "width", "length", F.col("area").alias("source"))
    water, wet = W.prepare_water(nodes, ways, relations, members, way_node, position, edges.select("x0", "y0", "x1", "y1"), w, h, scenery)
    wet = wet.where(F.lit(bool(on("waterways")))).select(F.lit("waterways").alias("category"), F.lit("water bed").alias("cls"), "face", "depth", F.col("fid").alias("source"))
    items = S.union_features(vegetation=trees, surfaces=faces, objects=points, mapped=mapped, buildings=built, water=wet)

    # Place nodes rank before relations and ways, as the first of one name within reach is kept.
    place = nodes.select("node_id", T.place_kind("tags").alias("place"), T.tag("tags", "name").alias("name")).where("place IS NOT NULL").join(position, "node_id")
    place, boxes = place.where(F.lit(bool(on("place_markers")))), boxes.where(F.lit(bool(on("place_markers"))))
    spots = place.where(on_map("x", "y", w, h)).select("name", "place", "x", "y", F.lit(0).alias("t"), name("node", "node_id").alias("source")).unionByName(
        boxes.where("place IS NOT NULL").select(T.tag("tags", "name").alias("name"), "place", F.col("px").alias("x"), F.col("py").alias("y"),
                                                F.when(F.col("area").startswith("relation"), 1).otherwise(2).alias("t"), F.col("area").alias("source")))
    labels = S.dedupe_places(settle(spots.withColumn("rank", F.struct("t", F.length("source").alias("l"), F.col("source").alias("s"))))).drop("rank", "t")
    every = nodes.select("tags").unionByName(ways.select("tags")).unionByName(relations.select("tags"))
    issues = notes.unionByName(odd.select("area", "reason"))
    gaps = N.missing_refs(way_node, nodes, "node_id").select(name("node", "node_id").alias("area"), F.lit("referenced node does not exist").alias("reason"))
    return {"nodes": N.network_nodes(edges), "edges": edges, "scenery": items, "labels": labels, "water": water,
            "unavailable": S.unavailable_tags(every), "issues": issues.unionByName(gaps)}


def terrain_context(nodes: DataFrame, ways: DataFrame, relations: DataFrame, spec: MapSpec, network: NetworkOptions = NetworkOptions()) -> dict:
    """What an extract tells a terrain build of one map (map_id 0): lines per kind, lakes, land cover and notes.

    Lines are the unbroken parts on the map of roads, rails and rivers (map_id, way_id, line, idx, x, y, structure); a line is named
    by way and part, padded, so lines of all kinds sort in way order. Lakes and cover are edges with the key lake or area; cover kinds
    are a table of their own.
    """
    prepare(nodes.sparkSession)
    w, h = spec.width, spec.height
    x, y = project_xy("lat", "lon", spec)
    nodes, ways, relations = settle(nodes), settle(ways), settle(relations)
    position = settle(nodes.select("node_id", x.alias("x"), y.alias("y")))
    way_node, members = settle(N.way_nodes(ways)), settle(relation_members(relations))
    flowing = T.one_of(T.tag("tags", "waterway"), T.STREAMS)
    kinds = ways.select("way_id", F.when(flowing, "river").otherwise(T.network_class("tags", network)).alias("kind"),
                        (T.structure_flag("tags", "bridge") | T.structure_flag("tags", "tunnel")).alias("structure")).where("kind IS NOT NULL")
    segments = N.way_segments(way_node.join(kinds.select("way_id"), "way_id", "left_semi"), position, way_node.count())
    cut = N.clip_segments(segments, w, h).where((F.col("cx0") != F.col("cx1")) | (F.col("cy0") != F.col("cy1")))
    chains = settle(N.line_chains(cut, ["way_id"]).join(kinds, "way_id").select(
        F.lit(0).alias("map_id"), "kind", "way_id", F.concat_ws(":", F.lpad(F.col("way_id").cast("string"), 20, "0"), F.lpad(F.col("chain").cast("string"), 8, "0")).alias("line"),
        "idx", "x", "y", "structure"))
    lakes, _, wet_notes = S.area_edges(ways, relations, members, way_node, position, lambda tags: F.when(T.terrain_water(tags), "lake"))
    cover, areas, notes = S.area_edges(ways, relations, members, way_node, position, T.landcover_kind)
    on_map_zero = lambda df, key: df.withColumnRenamed("area", key).withColumn("map_id", F.lit(0))
    return {"lines": {kind: chains.where(F.col("kind") == kind).drop("kind") for kind in ("river", "road", "rail")}, "lakes": on_map_zero(lakes, "lake"),
            "cover": on_map_zero(cover, "area"), "cover_kinds": areas.select("area", "kind"), "notes": wet_notes.unionByName(notes).distinct()}


@dataclass(frozen=True)
class TerrainOptions:
    """Steps of a terrain build; a step with a zero or empty setting is left out."""

    fill_m: float = 100.0
    keep_gaps: bool = False  # else a gap that is wider than fill_m ends the build
    scale: float = 1.0
    offset: float = 0.0
    smoothing_m: float = 0.0
    water_level: float = 0.0
    lake_depth: float = 5.0
    lake_feather: float = 8.0
    river: dict = field(default_factory=lambda: dict(width=20.0, blend=10.0, smoothing=20.0, percent=0.0, river_depth=4.0))
    road: dict = field(default_factory=lambda: dict(width=14.0, blend=20.0, smoothing=30.0, percent=8.0))
    rail: dict = field(default_factory=lambda: dict(width=10.0, blend=15.0, smoothing=50.0, percent=3.0))


def build_terrain(samples: DataFrame, by: list[str], grid: GridSpec, options: TerrainOptions = TerrainOptions(), lakes: DataFrame | None = None,
                  lines: dict[str, DataFrame] | None = None, strokes: DataFrame | None = None, biomes: BiomeOptions | None = None,
                  cover: DataFrame | None = None, paint: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cells from vertex samples (by, row, col, source, priority, z): gaps, scale, smoothing, lakes, corridors, strokes, biomes.

    ``samples`` holds a row for every vertex, null where a source has none; a gap that stays open is an error unless
    gaps are to be kept. ``lakes`` are edges with a lake key. ``lines`` are vertices per kind; they are applied in the order of
    their line, whatever the kind, and their profiles come from the ground before any refinement.
    """
    prepare(samples.sparkSession)
    every = samples.select(*by, "row", "col").distinct()
    best = R.first_valid(samples, by)
    base = settle(R.fill_gaps(every.join(best, [*by, "row", "col"], "left"), by, grid.dx, grid.dy, options.fill_m))
    base = base.select(*by, "row", "col", R.scale_offset("z", options.scale, options.offset).alias("z"))
    if options.smoothing_m:
        base = R.gaussian_smooth(base, by, options.smoothing_m / grid.dy, options.smoothing_m / grid.dx)
    base = settle(base)
    if not options.keep_gaps and (open_ := base.where("z IS NULL").count()):
        raise ValueError(f"{open_} vertices have no height within {options.fill_m:g} m")
    cells = base
    if lakes is not None:
        values = lakes.select("lake").distinct().withColumns({"value": F.lit(1), "ord": F.lit(1)})
        mask = R.rasterize_polygons(lakes, "lake", values, grid, by)
        cells = settle(R.carve_lakes(cells, mask, by, grid.dx, grid.dy, options.water_level - options.lake_depth, options.lake_feather))
    if lines:
        pulls = [E.corridor_segments(base, vertices, by, grid, **getattr(options, kind)) for kind, vertices in lines.items()]
        cells = settle(E.fold_corridors(cells, reduce(DataFrame.unionByName, pulls), by, grid))
    if strokes is not None:
        cells = settle(E.apply_strokes(cells, strokes, by, grid))
    out = {"cells": cells, "baseline": base, "range": R.elevation_range(cells, base, by)}
    if biomes is not None:
        sloped = R.terrain_slope(cells, by, grid.dx, grid.dy)
        stamp = E.paint_latest(paint, by, grid) if paint is not None else None
        out["biomes"] = R.classify_biomes(sloped, by, biomes, cover, stamp)
    return out
