"""Cases of the findings of round 4."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import faces as P
from geoloom.operators import polygons as G, spatial, water as W


def boxes_of(spark, rows):
    return spark.createDataFrame(rows, "bx0 double, by0 double, bx1 double, by1 double")


def triangles(spark, seed, count, half):
    rng = np.random.default_rng(seed)
    rows = [("way:%d" % (k % 7), str(k), [tuple(map(float, p)) for p in rng.uniform(-half, half, (3, 2))]) for k in range(count)]
    return spark.createDataFrame(rows, "fid string, no string, face array<struct<x:double,y:double>>")


def test_pieces_under_corridors_are_counted_and_not_written(spark):
    thin = triangles(spark, 3, 20, 100)
    cover = spatial.cover_of(boxes_of(spark, [(-200.0, -200.0, 10.0, 200.0), (5.0, -200.0, 200.0, 200.0)]), 200.0, 200.0)
    rows = W._pieces(thin, cover)
    assert rows.where("made IS NULL").count() == 0 and rows.count() == 20
    assert rows.agg(F.sum("made")).first()[0] == G.split_triangles(thin).count() > 1000


@pytest.mark.parametrize("seed, boxes, side", [(1, 0, 1), (2, 3, 60), (3, 40, 30), (4, 400, 12), (5, 60, 0)])
def test_pieces_free_of_corridors_as_by_comparison_with_all(spark, seed, boxes, side):
    rng, half = np.random.default_rng(seed), 50
    low = np.round(rng.uniform(-half - 20, half + 10, (boxes, 2)), 0)
    listed = boxes_of(spark, [tuple(map(float, (*a, *(a + b)))) for a, b in zip(low, np.round(rng.uniform(0, side, (boxes, 2)), 1))] or [(900.0, 900.0, 901.0, 901.0)])
    thin = triangles(spark, seed, 30, half - 0.01)
    x0, y0, x1, y1 = P.box_of("face")
    every = G.split_triangles(thin).select("fid", F.concat_ws(".", "no", "piece").alias("face_id"), "face", x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy"))
    want = every.join(listed, F.expr("minx <= bx1 AND maxx >= bx0 AND miny <= by1 AND maxy >= by0"), "left_anti")
    cover = spatial.cover_of(listed, 2.0 * half, 2.0 * half)
    faces = W._pieces(thin, cover).cache()
    got = W._free(faces.where("made IS NULL").drop("made"), listed, cover)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("fid", "face_id", "face").collect()))
    assert faces.agg(F.sum("made")).first()[0] == every.count()


def test_boxes_inside_of_full_cells_are_left_out(spark):
    rows = [(-60.0, -60.0, 60.0, 60.0), (-10.0, -10.0, 10.0, 10.0), (-70.0, -70.0, -50.0, -20.0)]
    small, inside, out = boxes_of(spark, rows[1:2]), boxes_of(spark, rows), boxes_of(spark, [(200.0, 0.0, 300.0, 9.0)])
    cover = spatial.cover_of(inside, 100.0, 100.0)
    assert spatial.boxes_at_rim(inside, cover).count() == 0
    assert spatial.boxes_at_rim(small, spatial.cover_of(small, 100.0, 100.0)).count() == 1
    assert spatial.boxes_at_rim(boxes_of(spark, [(0.5, 0.5, 1.2, 9.0)]), spatial.cover_of(small, 100.0, 5.0)).count() == 0
    thin = boxes_of(spark, [(0.5, 0.5, 1.2, 9.0)])
    assert spatial.boxes_at_rim(thin, spatial.cover_of(thin, 100.0, 100.0)).count() == 1
    assert spatial.boxes_at_rim(out, cover).count() == 0



def test_prepare_water_query_covers_the_faces(spark):
    from geoloom.plans import all_queries

    out = all_queries()[0]["prepare_water"](spark, "/root/testdata/sf0.001")
    rows = [r.asDict() for r in out.collect()]
    assert {"kept", "area", "depth", "reserved", "sized"} <= set(out.columns)
    done = [r for r in rows if r["status"] == "prepared"]
    assert sum(r["kept"] or 0 for r in done) == sum(r["faces"] for r in done) and sum(r["reserved"] for r in done) > 0
    assert all(r["depth"] is None or r["depth"] == 500 * r["kept"] for r in rows)


def test_listed_tiles_are_read_from_files_of_their_own(spark, tmp_path, monkeypatch):
    from geoloom.spec import GridSpec
    from geoloom.streaming import apply

    path, seen, plain = str(tmp_path / "grid"), [], apply._cells

    def cells_of(session, folder, listed, by):
        seen.append(listed._jdf.queryExecution().optimizedPlan().children().isEmpty())
        return plain(session, folder, listed, by)

    monkeypatch.setattr(apply, "_cells", cells_of)
    cells = spark.range(64 * 64).selectExpr("0L AS layer", "id DIV 64 AS row", "id % 64 AS col", "1e0 AS z")
    apply.store_cells(cells, path, ["layer"])
    schema = "layer long, seq long, tool string, x double, y double, radius double, strength double, target double"
    spark.createDataFrame([(0, 1, "Raise", 0.0, 0.0, 9.0, 1.0, 0.0)], schema).write.parquet(str(tmp_path / "strokes"))
    strokes = spark.readStream.schema(schema).parquet(str(tmp_path / "strokes"))
    apply.stream_strokes(strokes, path, ["layer"], GridSpec(252.0, 252.0, 64, 64), str(tmp_path / "checkpoint"))
    assert len(seen) == 1 and seen[0]
    assert apply.latest_cells(spark, path, ["layer"]).where("z > 1").count() > 4


def test_positions_are_as_large_to_a_plan_as_they_are(spark):
    from geoloom.plans.views import Views

    position = Views(spark, "/root/testdata/sf0.1").position
    assert int(str(position._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 8 * position.count()


def test_guides_are_joined_before_segments_are_cut(spark, monkeypatch):
    from geoloom.operators import networks as N
    from geoloom.plans.views import Views

    seen, plain = [], N.subdivide_edges
    monkeypatch.setattr(N, "subdivide_edges", lambda segments, *rest: seen.append(segments.columns) or plain(segments, *rest))
    v = Views(spark, "/root/testdata/sf0.001")
    edges = N.network_edges(v.ways, v.way_node, v.nodes, v.position, 1024.0, 1024.0)
    assert len(seen) == 1 and {"g0", "g1"} <= set(seen[0])
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join")  # pieces meet no join but that of rail ends with signals
    assert edges.where("t0 IS NOT NULL").count() > 0 and edges.where("t0 IS NOT NULL AND NOT (bridge OR tunnel)").count() == 0
