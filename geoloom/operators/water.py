"""Water features: statuses, ribbons and polygons, reserved corridors and the face budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from geoloom.functions import faces as P, tags as T
from geoloom.operators import graph, polygons as G
from geoloom.operators.networks import way_segments, way_totals
from geoloom.operators.ordered import top_per_key
from geoloom.operators.spatial import Cover, boxes_at_rim, clear_of_boxes, corridor_boxes, cover_of, held
from geoloom.session import settle, spread
from geoloom.spec import SceneryOptions

DEPTH = 0.5  # fixed bed depth of prepared shallow water, metres


def face_budget(features: DataFrame, budget: int | None = None) -> DataFrame:
    """Which features fit a shared face budget, in order: feature, faces, accepted. Without a budget all do.

    A feature is taken whole or not at all, and later ones see what is left. As the remainder only falls,
    the accepted features of one exact size are the first of that size, and at most budget / size of them.
    So only those may matter: under budget * (1 + ln(budget)) rows whatever the input, which one small
    group folds in order. All other features are refused or have no face.
    """
    sized = features.select("feature", "ord", "faces")
    if budget is None:
        return sized.select("feature", "faces", F.lit(True).alias("accepted"))
    small = sized.where((F.col("faces") > 0) & (F.col("faces") <= budget))
    hopeful = top_per_key(small, ["faces"], ["ord"], budget, "_rn").where(F.col("_rn") * F.col("faces") <= budget)

    def fold(pdf):
        pdf = pdf.sort_values("ord")
        left, taken = budget, []
        for n in pdf["faces"]:
            taken.append(bool(n <= left))
            left -= n if taken[-1] else 0
        return pdf.assign(accepted=taken)[["feature", "accepted"]]

    schema = hopeful.select("feature").schema.add("accepted", "boolean")
    chosen = hopeful.select("feature", "ord", "faces", F.lit(1).alias("one")).groupBy("one").applyInPandas(fold, schema)
    return sized.join(chosen, "feature", "left").select(
        "feature", "faces", F.coalesce("accepted", F.col("faces") == 0).alias("accepted"))


def water_features(nodes: DataFrame, ways: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """One row per water entity: type, id, kind, stage, reason; stage is candidate or a final status.

    Members of a water multipolygon, even of a broken one, belong to it and get no feature of their own.
    """
    kinds = lambda df, key, name: df.select(F.lit(name).alias("type"), F.col(key).alias("id"), T.water_kind("tags").alias("kind"),
                                            "tags").where("kind IS NOT NULL")
    w, n = kinds(ways, "way_id", "way"), kinds(nodes, "node_id", "node")
    r = kinds(relations, "rel_id", "relation")
    holds = relations.where(T.tag("tags", "type").isin("multipolygon", "waterway")).select("rel_id")
    seeds = r.select("type", "id").unionByName(w.select("type", "id")).unionByName(n.select("type", "id"))
    found = graph.water_closure(seeds, members.join(holds, "rel_id", "left_semi")).where("type = 'relation'")
    cats = settle(found.join(r.select("id", "kind"), "id", "left").select("id", F.coalesce("kind", F.lit("metadata-only")).alias("kind"))
                  .join(relations.select(F.col("rel_id").alias("id"), "tags"), "id"))
    multi = T.same(T.tag("tags", "type"), "multipolygon")
    inside = members.where(F.coalesce("role", F.lit("")).isin("", "outer", "inner")).join(
        cats.where(multi).select(F.col("id").alias("rel_id")), "rel_id", "left_semi").select("type", F.col("ref").alias("id")).distinct()
    nested = inside.where("type = 'relation'").select("id", F.lit(True).alias("nested"))
    rel = cats.join(nested, "id", "left").select(
        F.lit("relation").alias("type"), "id", "kind", "tags",
        F.when(F.col("nested"), "metadata-only").when(~multi, "metadata-only").otherwise("candidate").alias("stage"),
        F.when(F.col("nested"), "part of a parent polygon").when(~multi, "no polygon relation").alias("reason"))
    own = w.join(inside.where("type = 'way'").select("id"), "id", "left_anti")
    area = T.water_is_area("tags")
    way = own.select("type", "id", "kind", "tags",
                     F.when(F.col("kind") == "metadata-only", "metadata-only").when(area.isNull(), "needs-review").otherwise("candidate").alias("stage"),
                     F.when(F.col("kind") == "metadata-only", "no geometry treatment").when(area.isNull(), "area tags conflict").alias("reason"))
    node = n.select("type", "id", "kind", "tags", F.lit("metadata-only").alias("stage"), F.lit("point feature").alias("reason"))
    return rel.unionByName(way).unionByName(node)


def prepare_water(nodes: DataFrame, ways: DataFrame, relations: DataFrame, members: DataFrame, way_node: DataFrame,
                  position: DataFrame, corridors: DataFrame, width: float, height: float,
                  options: SceneryOptions = SceneryOptions()) -> tuple[DataFrame, DataFrame]:
    """(features with status, faces of prepared shallow water)."""
    way_node = way_node.select("way_id", "seq", "node_id")
    features = settle(water_features(nodes, ways, relations, members))
    open_ = features.where("stage = 'candidate'")
    treated = open_.where("kind = 'shallow'")
    key = ["type", "id"]

    # Polygons from relations.
    roots = open_.where("type = 'relation'").select(F.col("id").alias("rel_id"))
    tree, broken = graph.multipolygon_tree(roots, members, relations, ways)
    ordered = graph.member_order(tree)
    rings, bad = G.assemble_rings(ordered, way_node, ["root", "role"])
    rings, bad = settle(rings), settle(bad)
    no_outer = ordered.select("root").distinct().join(rings.where("role = 'outer'").select("root").distinct(), "root", "left_anti")
    failed = (broken.select("root", "reason").unionByName(bad.select("root", "reason"))
              .unionByName(no_outer.select("root", F.lit("no outer ring").alias("reason"))))
    placed = rings.join(position, "node_id", "left")
    holes = placed.where("x IS NULL").select("root", F.lit("missing node").alias("reason")).distinct()
    failed = settle(failed.unionByName(holes).groupBy("root").agg(F.min("reason").alias("why")))
    inner = F.col("role") == "inner"
    rel_vertices = placed.join(failed.select("root"), "root", "left_anti").select(
        F.lit("relation").alias("type"), F.col("root").alias("id"), (F.col("ring") * 2 + inner.cast("int")).alias("ring"),
        inner.alias("inner"), "idx", "n", "x", "y")

    # Polygons and lines from ways.
    way_ids = open_.where("type = 'way'").select(F.col("id").alias("way_id"), "tags", "kind")
    refs = settle(way_node.join(way_ids.select("way_id"), "way_id", "left_semi"))
    totals = way_totals(refs)
    gone = refs.join(position.select("node_id"), "node_id", "left_anti").select("way_id").distinct().withColumn("lost", F.lit(True))
    shape = settle(way_ids.join(totals, "way_id", "left").join(gone, "way_id", "left").select(
        "way_id", "tags", "kind", F.col("n"), F.coalesce("lost", F.lit(False)).alias("lost"), T.water_is_area("tags").alias("area"),
        ((F.col("n") > 3) & (F.col("first_node") == F.col("last_node"))).alias("closed")))
    way_why = (F.when(F.col("lost"), "missing node").when(F.coalesce("n", F.lit(0)) < 2, "too few nodes")
               .when(F.col("area") & ~F.col("closed"), "outline is not closed"))
    way_bad = shape.select("way_id", way_why.alias("why")).where("why IS NOT NULL")
    good = shape.join(way_bad, "way_id", "left_anti")
    way_vertices = (refs.join(good.where("area").select("way_id", "n"), "way_id").where(F.col("seq") < F.col("n") - 1)
                    .join(position, "node_id").select(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.lit(0).cast("long").alias("ring"),
                                                      F.lit(False).alias("inner"), F.col("seq").alias("idx"), (F.col("n") - 1).alias("n"), "x", "y"))
    vertices = rel_vertices.unionByName(way_vertices).join(treated.select(*key), key, "left_semi")
    vertices = settle(vertices.withColumn("fid", F.concat_ws(":", "type", F.col("id").cast("string"))))
    sides = settle(G.ring_edges(vertices, ["fid", "ring"]).join(vertices.where("idx = 0").select("fid", "ring", "inner", "n"), ["fid", "ring"]))
    invalid = settle(G.validate_rings(sides, vertices, "fid"))
    filled, odd = G.triangulate(sides.join(invalid, "fid", "left_anti"), ["fid"])

    size, source = T.waterway_width("tags", options.waterway_width)
    lines = settle(good.where("NOT area").select("way_id", "n", "closed", size.alias("width"), source.alias("width_source"), "kind"))
    lines_ok = lines.where("width IS NOT NULL AND kind = 'shallow'")
    seg = way_segments(refs.join(lines_ok.select("way_id"), "way_id", "left_semi"), position, refs.count()).join(lines_ok, "way_id").select(
        F.concat(F.lit("way:"), F.col("way_id").cast("string")).alias("fid"), F.col("seq").alias("idx"), "x0", "y0", "x1", "y1", "width",
        (F.col("n") - 2).alias("last"), F.col("closed"))
    ribbons = G.ribbon_faces(seg, ["fid"])
    strip = G.face_triangles(ribbons, ["fid", "idx", "part"])
    raw = (filled.select("fid", F.concat_ws(".", "band", "pair", "half").alias("no"), "face")
           .unionByName(strip.select("fid", F.concat_ws(".", F.col("idx"), F.col("part"), "band", "pair", "half").alias("no"), "face")))
    cut = G.clip_polygons(raw, width - 0.02, height - 0.02).where(F.size("face") >= 3)
    thin = settle(G.face_triangles(cut, ["fid", "no"]).select("fid", F.concat_ws(".", "no", "band", "pair", "half").alias("no"), "face"))
    boxes = corridor_boxes(corridors, [], options.corridor_margin)
    cover = cover_of(boxes, width, height)
    faces = settle(_pieces(spread(thin, ["fid", "no"]), cover))
    free = settle(_free(faces.where("made IS NULL").drop("made"), boxes, cover))
    counts = faces.groupBy("fid").agg(F.sum("made").alias("made")).where("made > 0").join(
        free.groupBy("fid").agg(F.count(F.lit(1)).alias("faces")), "fid", "left").select(
        "fid", "made", F.coalesce("faces", F.lit(0)).alias("faces"))
    stage_of = F.when(F.col("fid").startswith("relation:"), 0).otherwise(1)
    ordered_counts = counts.select(F.col("fid").alias("feature"), F.struct(stage_of.alias("s"), F.split("fid", ":")[1].cast("long").alias("i")).alias("ord"),
                                   "faces")
    flat = ordered_counts.select("feature", (F.col("ord.s") * 10 ** 15 + F.col("ord.i")).alias("ord"), "faces")
    budget = settle(face_budget(flat, options.face_budget))

    why = (invalid.select("fid", F.col("reason").alias("why")).unionByName(odd.select("fid", F.lit("cannot be filled").alias("why")))
           .unionByName(lines.where("width IS NULL AND kind = 'shallow'").select(
               F.concat(F.lit("way:"), F.col("way_id").cast("string")).alias("fid"), F.lit("width outside 0.1-20 m").alias("why")))
           .unionByName(way_bad.select(F.concat(F.lit("way:"), F.col("way_id").cast("string")).alias("fid"), "why"))
           .unionByName(failed.select(F.concat(F.lit("relation:"), F.col("root").cast("string")).alias("fid"), "why"))
           .unionByName(budget.where("NOT accepted").select(F.col("feature").alias("fid"), F.lit("face budget reached").alias("why"))))
    why = why.groupBy("fid").agg(F.min("why").alias("why"))
    named = features.withColumn("fid", F.concat_ws(":", "type", F.col("id").cast("string"))).join(why, "fid", "left").join(counts, "fid", "left").join(
        lines.select(F.concat(F.lit("way:"), F.col("way_id").cast("string")).alias("fid"), "width", "width_source"), "fid", "left")
    status = (F.when(F.col("stage") != "candidate", F.col("stage"))
              .when(F.col("why").isNotNull(), "needs-review").when(F.col("kind") == "lake", "unsupported-lake")
              .when(F.col("kind") != "shallow", "metadata-only").otherwise("prepared"))
    out = named.select("type", "id", "kind", T.tag("tags", "name").alias("name"), T.tag("tags", "ele").alias("ele_raw"), "width", "width_source",
                       status.alias("status"), F.coalesce("why", "reason").alias("reason"),
                       F.when(status == "prepared", F.coalesce("faces", F.lit(0))).alias("faces"),
                       F.when(status == "prepared", F.coalesce(F.col("made") - F.col("faces"), F.lit(0))).alias("reserved"))
    taken = budget.where("accepted").select(F.col("feature").alias("fid"))
    kept = free.join(taken, "fid", "left_semi").select("fid", "face_id", P.ccw("face").alias("face"), F.lit(DEPTH).alias("depth"))
    return out, kept


def _pieces(thin: DataFrame, cover: Cover, limit: float = 8.0, most: int = 1 << 15) -> DataFrame:
    """Split triangles (fid, no, face): fid, face_id, face, open, made.

    A piece that touches a full cell of the cover is reserved: it is counted and not written. The others have a row, ``open`` where only the boxes
    can tell, and null as made; one row more for each triangle has the number of its pieces and no face.
    """
    rows = thin.select("fid", "no", F.col("face").cast(P.FACE).alias("face")).where(F.size("face") == 3)
    schema = StructType([*rows.schema.fields, StructField("piece", StringType()), StructField("open", BooleanType()), StructField("made", LongType())])

    def run(batches):
        full, met = cover.tables()

        def spans(p):
            return cover.spans(*p.min(1).T, *p.max(1).T)

        def ruled_out(p):
            i0, j0, i1, j1 = span = spans(p)
            return held(full, *span) == (i1 - i0) * (j1 - j0)

        for batch in batches:
            made = np.zeros(batch.num_rows, np.int64)
            for of, piece, p in G.bisected(G.corners(batch), limit, most, ruled_out, made):
                span = spans(p)
                left = np.flatnonzero(held(full, *span) == 0)
                if left.size:
                    i0, j0, i1, j1 = span = [v[left] for v in span]
                    inside = (i0 >= 0) & (j0 >= 0) & (i1 < met.shape[1]) & (j1 < met.shape[0])
                    kept = batch.take(pa.array(of[left]))
                    yield pa.RecordBatch.from_arrays([kept.column("fid"), kept.column("no"), G.triangles(p[left]), pa.array(piece[left].tolist(), pa.string()),
                                                      pa.array(~inside | (held(met, *span) > 0)), pa.nulls(left.size, pa.int64())], schema.names)
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("fid"), batch.column("no"), pa.nulls(size, batch.column("face").type), pa.nulls(size, pa.string()),
                                              pa.nulls(size, pa.bool_()), pa.array(made)], schema.names)

    return rows.mapInArrow(run, schema).select("fid", F.concat_ws(".", "no", "piece").alias("face_id"), "face", "open", "made")


def _free(faces: DataFrame, boxes: DataFrame, cover: Cover) -> DataFrame:
    """Faces that meet no box. Open ones are written with a number, which moves to the cells of the join in place of their two names."""
    x0, y0, x1, y1 = P.box_of("face")
    open_ = settle(faces.where("open").select("fid", "face_id", "face", x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy"),
                                              F.monotonically_increasing_id().alias("_f")))
    names = ["fid", "face_id", "face"]
    return faces.where("NOT open").select(*names).unionByName(clear_of_boxes(open_, settle(boxes_at_rim(boxes, cover)), [], "_f").select(*names))
