"""Readers, the dataset store and catalogues on small files."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import tags as T
from geoloom.functions.register import register
from geoloom.operators import scenery as S, tiling, water as W
from geoloom.sources import catalog as C, dataset as D, osm as O
from geoloom.sources.points import read_points
from geoloom.sources.rasters import read_ascii_grid, read_hgt


def test_extract_needs_nodes_and_good_coordinates(spark, tmp_path):
    empty = tmp_path / "a.osm"
    empty.write_text('<osm version="0.6"><bounds minlat="0" minlon="0" maxlat="1" maxlon="1"/></osm>')
    with pytest.raises(ValueError):
        O.read_osm(spark, str(empty))
    bad = tmp_path / "b.osm"
    bad.write_text('<osm><node id="1" lat="89" lon="0"/><way id="2"><nd ref="1"/><nd ref="1"/><tag k="a" v="1"/><tag k="a" v="2"/></way></osm>')
    tables = O.read_osm(spark, str(bad))
    with pytest.raises(Exception):
        tables["nodes"].collect()
    way = tables["ways"].first()
    assert way.refs == ["1", "1"] and way.tags == {"a": "2"}


def test_the_last_of_equal_ids_wins(spark, tmp_path):
    path = tmp_path / "c.osm"
    path.write_text('<osm><node id="1" lat="1" lon="1"/><node id="2" lat="2" lon="2"/><node id="1" lat="3" lon="3"><tag k="a" v="b"/></node>'
                    '<way id="5"><nd ref="1"/></way><way id="5"><nd ref="2"/><nd ref="1"/></way></osm>')
    tables = O.read_osm(spark, str(path))
    assert sorted((r.node_id, r.lat, r.tags) for r in tables["nodes"].collect()) == [("1", 3.0, {"a": "b"}), ("2", 2.0, {})]
    assert [(r.way_id, r.refs) for r in tables["ways"].collect()] == [("5", ["2", "1"])]


def test_dense_boxes_split_alone(spark):
    points = spark.createDataFrame([(.001 * (i % 10) + .0005, .001 * (i // 10) + .0005) for i in range(100)] + [(.0005, .0005)] * 50, "lat double, lon double")
    boxes = spark.createDataFrame([("a", 0.0, 0.0, .01, .01), ("b", 0.0, 0.0, .005, .01), ("far", 1.0, 1.0, 1.1, 1.1)], "k string, south double, west double, north double, east double")
    rows = tiling.split_dense_parts(points, boxes, ["k"], 30, 100.0).collect()
    total = {k: sum(r.rows for r in rows if r.k == k) for k in "ab"}
    assert total == {"a": 150, "b": 100} and [(r.part, r.rows) for r in rows if r.k == "far"] == [("p", 0)]
    assert max(r.rows for r in rows if r.k == "a" and not (r.south == 0 and r.west == 0)) <= 30
    assert {(r.part, r.rows) for r in rows if r.k == "b"} != {(r.part, r.rows) for r in rows if r.k == "a"}


def test_merged_entities_keep_their_content(spark):
    rows = [(1, "node", 1, {"a": "1"}, ["x"]), (2, "node", 1, {"a": "1"}, ["x"])]
    good, _ = O.merge_osm_parts(spark.createDataFrame(rows, "part int, kind string, id int, attrs map<string,string>, children array<string>"))
    assert [(r.copies, r.attrs, r.children) for r in good.collect()] == [(2, {"a": "1"}, ["x"])]


def test_binary_tiles(spark, tmp_path):
    grid = np.arange(25, dtype=">i2").reshape(5, 5)
    grid[0, 0] = -32768
    (tmp_path / "S01W002.hgt.gz").write_bytes(gzip.compress(grid.tobytes()))
    rows = {(r.row, r.col): r for r in read_hgt(spark, str(tmp_path / "*.gz")).collect()}
    assert rows[0, 0].z is None and rows[4, 4].z == 24 and (rows[4, 4].lat, rows[4, 4].lon) == (-1.0, -1.0) and (rows[0, 0].lat, rows[0, 0].lon) == (0.0, -2.0)
    (tmp_path / "N01E001.hgt").write_bytes(b"\0" * 30)
    with pytest.raises(Exception):
        read_hgt(spark, str(tmp_path / "*.hgt")).collect()


def test_ascii_grids(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2 -9999\n4 5 6\n")
    rows = {(r.row, r.col): r for r in read_ascii_grid(spark, str(tmp_path / "a.asc")).collect()}
    assert rows[0, 2].z is None and rows[1, 0].z == 4 and (rows[0, 0].x, rows[0, 0].y) == (11, 23) and (rows[1, 2].x, rows[1, 2].y) == (15, 21)


def test_point_files_split_by_records(spark, tmp_path):
    n = 1000
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    struct.pack_into("<6d", head, 131, .01, .01, .01, 100., 200., 0.)
    struct.pack_into("<4d", head, 179, 109.99, 100., 200., 190.01)
    body = b"".join(struct.pack("<3iHBBbBH", i, -i, 2 * i, 0, 0, 2 | (128 if i % 10 == 0 else 0), 0, 0, 0) for i in range(n))
    (tmp_path / "p.las").write_bytes(bytes(head) + body)
    df = read_points(spark, str(tmp_path / "p.las"), chunk=128)
    assert df.count() == n
    row = df.where("abs(x - 107) < 1e-9").first()
    assert (round(row.y, 6), round(row.z, 6), row.classification, row.withheld) == (193, 14, 2, True) and df.where("withheld").count() == 100
    assert read_points(spark, str(tmp_path / "p.las"), max_points=10).count() == 0
    assert read_points(spark, str(tmp_path / "p.las"), box=(100, 100, 101, 300)).count() == 101
    # A header whose box lies elsewhere keeps its file unread.
    struct.pack_into("<4d", head, 179, 2.0, 1.0, 2.0, 1.0)
    (tmp_path / "q.las").write_bytes(bytes(head) + body)
    assert read_points(spark, str(tmp_path / "q.las"), box=(100, 100, 101, 300)).count() == 0


def test_report_keeps_its_fields_only(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"dataset": "d", "bounds": [0, 0, 1, 1], "mapSize": [10, 20], "edges": 3, "waterMetadata": {"x": [1, 2]}}))
    df = D.read_report(spark, str(path))
    assert "waterMetadata" not in df.columns and len(df.columns) == 16 and df.first().edges == 3
    path.write_text('{"dataset": "d", "bounds": [0')
    with pytest.raises(Exception):
        D.read_report(spark, str(path)).collect()


def test_dataset_round_trip_and_tampering(spark, tmp_path):
    tables = {"a": spark.range(100).withColumn("v", F.col("id") % 7), "b": spark.range(5).selectExpr("id", "array(id) AS l")}
    first = D.write_map_dataset(tables, str(tmp_path / "one"), {"size": [1, 2]})
    again = D.write_map_dataset({k: t.repartition(3) for k, t in tables.items()}, str(tmp_path / "two"), {"size": [1, 2]})
    assert first == again and len(first) == 24
    schemas = {k: t.schema for k, t in tables.items()}
    back, manifest = D.read_map_dataset(spark, str(tmp_path / "one"), schemas)
    assert D.same_dataset(back["a"], tables["a"]).count() == 0 and manifest["counts"] == {"a": 100, "b": 5}
    tables["a"].limit(1).write.mode("append").parquet(str(tmp_path / "one" / f"data-{manifest['version']}" / "a"))
    with pytest.raises(ValueError):
        D.read_map_dataset(spark, str(tmp_path / "one"), schemas)
    assert D.same_dataset(tables["a"].union(tables["a"].limit(1)), tables["a"]).count() == 1


def test_merge_finds_changed_copies(spark):
    rows = [(1, "node", 1, {"a": "1", "b": "2"}, ["x"]), (2, "node", 1, {"b": "2", "a": "1"}, ["x"]), (1, "way", 1, {}, ["1", "2"]), (2, "way", 1, {}, ["2", "1"])]
    good, bad = O.merge_osm_parts(spark.createDataFrame(rows, "part int, kind string, id int, attrs map<string,string>, children array<string>"))
    assert [(r.kind, r.copies) for r in good.collect()] == [("node", 2)] and [r.kind for r in bad.collect()] == ["way"]


def test_parts_cover_their_box(spark):
    box = spark.createDataFrame([(1, 59.0, 18.0, 59.2, 18.5)], "id int, south double, west double, north double, east double")
    parts = tiling.partition_bbox(box, ["id"]).collect()
    assert min(p.south for p in parts) == 59.0 and max(p.east for p in parts) == 18.5
    assert abs(sum((p.north - p.south) * (p.east - p.west) for p in parts) - .1) < 1e-12 and len(parts) == 4 * 3
    with pytest.raises(Exception):
        tiling.partition_bbox(box.withColumn("east", F.lit(40.0)), ["id"], most=64).collect()


def test_dense_parts_split_until_small(spark):
    points = spark.range(2000).selectExpr("1e-3 * (id % 50) / 50 AS lat", "1e-3 * (id / 50) / 50 AS lon")
    box = spark.createDataFrame([(0, 0.0, 0.0, 0.1, 0.1)], "k int, south double, west double, north double, east double")
    parts = tiling.split_dense_parts(points, box, ["k"], 300, smallest_m=10.0).collect()
    assert sum(p["rows"] for p in parts) == 2000 and max(p["rows"] for p in parts) <= 300
    assert abs(sum((p.north - p.south) * (p.east - p.west) for p in parts) - .01) < 1e-12


def test_full_file_list_swaps_unknowns_for_overlaps(spark):
    kinds = ["unknown", "overlap", "unknown", "unknown", "overlap", "overlap", "unknown"]
    df = spark.createDataFrame([(i, f"f{i}", f"n{i}", k) for i, k in enumerate(kinds)], "scan int, path string, name string, coverage string")
    kept = [r.path for r in C.rank_files(df, 4).orderBy("place").collect()]
    # Arrivals 0-3 fill the list; overlaps 4 and 5 push out unknowns 0 and 2.
    assert kept == ["f1", "f4", "f5", "f3"]


def test_face_budget_is_all_or_nothing(spark):
    sizes = [10, 95, 0, 60, 40, 30, 20, 10, 101, 1]
    df = spark.createDataFrame([(i, i, n) for i, n in enumerate(sizes)], "feature int, ord int, faces int")
    left, want = 100, []
    for n in sizes:
        want.append(n <= left)
        left -= n if want[-1] else 0
    assert [r.accepted for r in W.face_budget(df, 100).orderBy("feature").collect()] == want


def test_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT haversine_m(0, 0, 0, 1) AS d, (SELECT COUNT(*) FROM covering_tiles(0D, 0D, 0.1D, 0.2D, 12)) AS n").first()
    assert abs(row.d - 111195.08) < .01 and row.n == 9


def test_sql_tag_rules_equal_the_column_rules(spark):
    register(spark)
    values = {"maxspeed": [None, "50", "30 mph", " 70 KM/H", "1e2", "-5", "0", "signals", ".5mph"], "water": [None, "pond", "lake", "no", "river", ""],
              "landuse": [None, "basin", "forest", "", "meadow"], "natural": [None, "water", "wood", "heath", "spring"], "waterway": [None, "canal", "dam"], "surface": [None, "", "asphalt", "mud"]}
    rows = [({k: v[i * (n + 1) % len(v)] for n, (k, v) in enumerate(values.items()) if v[i * (n + 1) % len(v)] is not None},) for i in range(180)]
    df = spark.createDataFrame(rows, "tags map<string,string>")
    df.createOrReplaceTempView("tagged")
    got = spark.sql("SELECT max_speed_kmh(tags) AS a, water_kind(tags) AS b, surface_kind(tags) AS c FROM tagged").collect()
    want = df.select(T.max_speed_kmh("tags"), T.water_kind("tags"), T.surface_kind("tags")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_sidecars_belong_to_a_files_identity(spark):
    listing = spark.createDataFrame([("d/a.tif", 10, 1), ("d/a.prj", 1, 1), ("d/a.tif.aux.xml", 2, 1), ("d/b.las", 5, 1), ("d/b.prj", 1, 1), ("d/c.asc", 7, 1)], "path string, size long, mtime long")
    rows = {r.path: r.sidecars for r in C.with_sidecars(listing).collect()}
    assert rows == {"d/a.tif": "d/a.prj:1:1|d/a.tif.aux.xml:2:1", "d/b.las": "", "d/c.asc": ""}
    seen = C.with_sidecars(listing).withColumn("kind", F.when(F.col("path") != "d/c.asc", "grid"))
    later = C.with_sidecars(listing.withColumn("mtime", F.when(F.col("path") == "d/a.prj", 2).otherwise(F.col("mtime"))))
    out = {r.path: r.reused for r in C.scan_extents(later, seen, lambda df: df.withColumn("kind", F.lit("grid"))).collect()}
    assert out == {"d/a.tif": False, "d/b.las": True, "d/c.asc": False}  # a changed description, and a failure that is tried again


def test_curated_candidates_and_their_place(spark):
    face = "array<struct<x:double,y:double>>"
    objects = spark.createDataFrame([(1, "bench", None, None, None, None, 10.0, 20.0, 0.0)], f"item_id int, kind string, height double, width double, length double, shape {face}, x double, y double, rotation double")
    models = spark.createDataFrame([("a", "bench", 0, 1.0, 2.0, 1.0, 3.0, 4.0), ("z", "bench", 0, 1.0, 2.0, 1.0, 3.0, 4.0), ("b", "bench", 1, 1.0, 2.0, 1.0, 0.0, 0.0)],
                                   "name string, kind string, tier int, width double, length double, height double, cx double, cy double")
    row, = S.match_candidates(objects, models, curated={"bench": "z"}).collect()
    assert (row.name, row.score, row.px, row.py, row.turn) == ("z", 0.0, 7.0, 16.0, 0.0)
    assert S.match_candidates(objects, models.where("tier = 1"), tiers=1).first().unmatched


def test_point_files_round_trip(spark, tmp_path):
    from geoloom.sources.points import write_las

    rows = spark.range(2500).selectExpr("id * 0.25 AS x", "-id * 0.5 AS y", "id % 7 AS z", "CAST(id % 5 AS INT) AS classification", "id % 3 = 0 AS withheld")
    files = write_las(rows.repartition(3), str(tmp_path / "out"), most=400).collect()
    assert sum(f.n for f in files) == 2500 and all(f.n <= 800 for f in files)
    key = lambda df: sorted((round(r.x, 2), round(r.y, 2), round(r.z, 2), r.classification, r.withheld) for r in df.collect())
    assert key(read_points(spark, str(tmp_path / "out/*.las"), chunk=100)) == key(rows)


def test_reports_refuse_repeated_names(spark, tmp_path):
    from geoloom.sources.dataset import read_report

    good = '{"dataset": "d", "bounds": [0, 0, 1, 1], "mapSize": [1, 2], "settings": {"a": "1"}}'
    (tmp_path / "a.json").write_text(good)
    assert read_report(spark, str(tmp_path / "a.json")).first().dataset == "d"
    (tmp_path / "b.json").write_text(good.replace('{"a": "1"}', '{"a": "1", "a": "2"}'))
    with pytest.raises(Exception, match="twice"):
        read_report(spark, str(tmp_path / "b.json")).collect()


def test_fingerprints_tell_names_and_frames_apart(spark):
    from geoloom.sources.dataset import fingerprint

    mark = lambda rows, schema: fingerprint(spark.createDataFrame(rows, schema)).first().fingerprint
    marks = [mark([("p", "q")], "a string, b string"), mark([("p", "q")], "a string, c string"), mark([("p\x1fq", "r")], "a string, b string"),
             mark([("p", "q\x1fr")], "a string, b string"), mark([(None, "q")], "a string, b string"), mark([("\\N", "q")], "a string, b string"), mark([("-", "q")], "a string, b string")]
    assert len(set(marks)) == len(marks)


def test_places_without_a_name(spark):
    rows = [(1, None, 0.0, 0.0), (2, None, 10.0, 0.0), (3, "a", 0.0, 0.0), (4, "", 0.0, 0.0), (5, None, 900.0, 0.0)]
    out = S.dedupe_places(spark.createDataFrame(rows, "rank long, name string, x double, y double"))
    assert {(r.rank, r.name) for r in out.collect()} == {(1, None), (3, "a"), (4, ""), (5, None)}


def test_rules_of_partial_inputs(spark):
    from geoloom.operators import quality as Q, raster as R
    from geoloom.sources.osm import validate_osm

    empty = spark.createDataFrame([], "node_id long, lat double, lon double")
    ways, rels = spark.createDataFrame([], "way_id long"), spark.createDataFrame([], "rel_id long")
    _, rejects = validate_osm(empty, ways, rels, formats=spark.createDataFrame([("a.osm", "0.6"), ("b.osm", "0.5"), ("c.osm", None)], "file string, version string"))
    assert sorted(r.id for r in rejects.collect()) == ["b.osm", "c.osm"]
    grid = spark.createDataFrame([(r, c, 63) for r in range(2) for c in range(3)], "row long, col long, code int")
    assert R.import_biomes(grid, shape=(2, 3))[0].count() == 6
    with pytest.raises(ValueError):
        R.import_biomes(grid, shape=(3, 2))
    failed = spark.createDataFrame([(1, 5, 6, 1), (2, 5, 6, 9), (3, 5, 6, 3)], "dataset_id long, first long, last long, found_id long")
    journal = spark.createDataFrame([(1, 1, 2, 7)], "dataset_id long, first long, last long, entity long")
    items = spark.createDataFrame([(d, i, True, True, True, d != 3) for d in (1, 2, 3) for i in (5, 6)], "dataset_id long, index long, selected boolean, ground boolean, collapses boolean, resolved boolean")
    out = {r.dataset_id: r.reason for r in Q.retry_safety(failed, journal, items, journal.select("dataset_id", "entity").limit(0)).collect()}
    assert out == {1: "safe to replay", 2: "the original dataset is required", 3: "a selected item cannot be resolved"}
    members = spark.createDataFrame([(1, "way", 1, "outer"), (1, "way", 2, None), (1, "node", 3, "outer"), (1, "way", 4, "label")], "rel_id long, type string, ref long, role string")
    some = spark.createDataFrame([(k,) for k in range(1, 5)], "way_id long")
    left = lambda **kw: sorted(r.way_id for r in S.uncovered_ways(some, members, **kw).collect())
    assert left() == [3] and left(roles=("outer", "")) == [3, 4] and left(closed=some.where("way_id = 2")) == [1, 3, 4]
