"""A small extract end to end, water areas and corridor lines."""

import pytest
from pyspark.sql import functions as F

from geoloom.functions import faces as P, tags as T
from geoloom.operators import networks as N
from geoloom.plans.pipelines import TerrainOptions, build_terrain, convert_map, terrain_context
from geoloom.sources.osm import read_osm
from geoloom.spec import BiomeOptions, Bounds, GridSpec, MapSpec, SceneryOptions

BOX = 0.01


def write_map(path, nodes, ways, relations=()):
    """nodes: {id: (x, y, tags)} on a 100 m map; the file holds the matching degrees."""
    tag = lambda tags: "".join(f'<tag k="{k}" v="{v}"/>' for k, v in tags.items())
    text = [f'<?xml version="1.0"?>\n<osm version="0.6">\n<bounds minlat="{-BOX / 2}" minlon="{-BOX / 2}" maxlat="{BOX / 2}" maxlon="{BOX / 2}"/>']
    text += [f'<node id="{i}" lat="{y / 100 * BOX!r}" lon="{x / 100 * BOX!r}">{tag(t)}</node>' for i, (x, y, t) in nodes.items()]
    text += [f'<way id="{i}">{"".join(f"<nd ref=\"{r}\"/>" for r in refs)}{tag(t)}</way>' for i, (refs, t) in ways.items()]
    text += [f'<relation id="{i}">{"".join(f"<member type=\"{a}\" ref=\"{b}\" role=\"{c}\"/>" for a, b, c in ms)}{tag(t)}</relation>' for i, ms, t in relations]
    path.write_text("\n".join(text + ["</osm>\n"]))
    return str(path)


@pytest.fixture(scope="module")
def extract(spark, tmp_path_factory):
    n = {1: (-40, -20, {}), 2: (-20, -20, {}), 3: (-20, 0, {}), 4: (-40, 0, {}),                            # pond
         10: (0, -15, {}), 11: (40, -15, {}), 12: (40, 25, {}), 13: (0, 25, {}),                          # pond with an island
         14: (15, 0, {}), 15: (25, 0, {}), 16: (25, 10, {}), 17: (15, 10, {}),
         20: (-45, 10, {}), 21: (-25, 10, {}), 22: (-25, 24, {}),                                          # stream
         30: (-48, 48.5, {"highway": "crossing"}), 31: (60, 48.5, {}), 32: (-10, -48.5, {"railway": "signal", "railway:signal:direction": "backward"}),
         33: (20, -48.5, {}), 40: (5, -10, {"natural": "tree"}), 41: (8, -12, {"amenity": "bench"}), 42: (9, -12, {"amenity": "cafe"}),
         43: (10, -14, {"place": "village", "name": "Aby"}), 44: (12, -14, {"place": "town", "name": "Aby"}), 45: (13, -14, {"place": "farm", "name": "X"}),
         50: (20, -30, {}), 51: (30, -30, {}), 52: (30, -24, {}), 53: (20, -24, {}), 60: (-10, -30, {}), 61: (10, -30, {}), 62: (10, -10, {}), 63: (-10, -10, {})}
    w = {101: ([1, 2, 3, 4, 1], {"water": "pond"}), 102: ([10, 11, 12, 13, 10], {}), 103: ([14, 15, 16, 17, 14], {}),
         104: ([20, 21, 22], {"waterway": "stream"}), 105: ([30, 31], {"highway": "residential", "oneway": "-1", "bridge": "yes"}),
         106: ([33, 32], {"railway": "rail", "maxspeed": "100 mph", "tunnel": "yes"}), 107: ([50, 51, 52, 53, 50], {"building": "house", "height": "20 ft"}),
         108: ([60, 61, 62, 63, 60], {"surface": "asphalt"}), 109: ([1, 999, 2], {"highway": "track"}), 110: ([1, 2, 3], {"natural": "water"}),
         111: ([1, 2, 3, 4, 1], {"water": "lake", "ele": "12"})}
    r = [(201, [("way", 102, "outer"), ("way", 103, "inner")], {"type": "multipolygon", "water": "basin"}),
         (202, [("relation", 203, "outer")], {"type": "multipolygon", "landuse": "forest"}), (203, [("relation", 202, "outer")], {"type": "multipolygon"})]
    path = write_map(tmp_path_factory.mktemp("map") / "small.osm", n, w, r)
    tables = read_osm(spark, path)
    assert tables["bounds"].first().north == BOX / 2
    return tables


SPEC = MapSpec(Bounds(-BOX / 2, -BOX / 2, BOX / 2, BOX / 2), 100.0, 100.0)


@pytest.fixture(scope="module")
def dataset(extract):
    return convert_map(extract["nodes"], extract["ways"], extract["relations"], SPEC)


def test_switches_leave_features_out(extract):
    off = {name: False for name in ("surfaces", "waterways", "tree_nodes", "place_markers")}
    out = convert_map(extract["nodes"], extract["ways"], extract["relations"], SPEC, scenery=SceneryOptions(features=off))
    found = {(r.category, r.match_kind) for r in out["scenery"].select("category", "match_kind").distinct().collect()}
    assert found == {("mappedObjects", "bench"), ("buildings", "residential")} and out["labels"].count() == 0


def test_extract_shapes_the_ground(spark, extract):
    context = terrain_context(extract["nodes"], extract["ways"], extract["relations"], SPEC)
    ways = {kind: {(r.way_id, r.structure) for r in df.select("way_id", "structure").distinct().collect()} for kind, df in context["lines"].items()}
    assert ways == {"river": {("104", False)}, "road": {("105", True)} | ways["road"] - {("105", True)}, "rail": {("106", True)}}
    ends = context["lakes"].groupBy("lake").agg(F.sum("x0").alias("a"), F.sum("x1").alias("b")).collect()
    assert all(abs(r.a - r.b) < 1e-9 for r in ends)
    grid = GridSpec(100.0, 100.0, 51, 51)
    flat = spark.range(51 * 51).selectExpr("0 AS map_id", "CAST(id / 51 AS BIGINT) AS row", "id % 51 AS col", "'a' AS source", "1 AS priority", "10D AS z")
    lines = {k: v for k, v in context["lines"].items()}
    out = build_terrain(flat, ["map_id"], grid, TerrainOptions(water_level=0.0), lines=lines)
    low = {(r.row, r.col) for r in out["cells"].where("z < 9").collect()}
    # The stream runs through (-35, 10); the bridge and the tunnel at the south and north leave no mark.
    assert (20, 7) in low and not any(row in (0, 1, 49, 50) for row, _ in low)


def test_open_gaps_end_a_build_unless_kept(spark):
    grid = GridSpec(256.0, 256.0, 65, 65)
    rows = spark.range(65 * 65).selectExpr("0 AS m", "CAST(id / 65 AS BIGINT) AS row", "id % 65 AS col", "'a' AS source", "1 AS priority", "CASE WHEN id < 100 THEN 5D END AS z")
    with pytest.raises(ValueError, match="have no height"):
        build_terrain(rows, ["m"], grid, TerrainOptions(fill_m=8.0))
    kept = build_terrain(rows, ["m"], grid, TerrainOptions(fill_m=8.0, keep_gaps=True))["cells"]
    assert kept.where("z IS NULL").count() > 0


def test_water_areas(dataset):
    area = {r.source: r.a for r in dataset["scenery"].where("category = 'waterways'").groupBy("source").agg(F.sum(P.signed_area("face")).alias("a")).collect()}
    rows = {(r.type, r.id): r for r in dataset["water"].collect()}
    assert rows["relation", "201"].status == "prepared" and rows["way", "101"].status == "prepared"
    assert rows["way", "110"].status == "needs-review" and rows["way", "111"].status == "unsupported-lake"
    assert rows["way", "104"].width_source == "fallback" and rows["way", "104"].width == 2.0
    assert ("way", "102") not in rows and ("way", "103") not in rows
    assert abs(area["way:101"] - 400) < 1e-2 and abs(area["relation:201"] - 1500) < 1e-2
    assert rows["way", "101"].faces > 0 and rows["way", "101"].reserved == 0
    for row in dataset["scenery"].where("source = 'relation:201'").collect():
        x, y = sum(p.x for p in row.face) / 3, sum(p.y for p in row.face) / 3
        assert not (15 < x < 25 and 0 < y < 10)


def test_network(dataset):
    edges = {r.edge_id: r for r in dataset["edges"].collect()}
    road, rail = edges["105:0:0"], edges["106:0:0"]
    # Reversed one-way, clipped at the east border: its start is a new node, its end an old one.
    assert (road.node0, edges["105:0:1"].node1) == ("105:0:0", "30") and road.oneway and abs(road.x0 - 50) < 1e-6
    assert road.t0 == 0 and abs(edges["105:0:1"].t1 - 1) < 1e-12 and road.depth == 8.0
    assert rail.kind == "TRACK" and abs(rail.speed - 160.9344) < 1e-9 and rail.cls == "track/high_speed"
    assert rail.signal == "signal" and rail.backward and edges["105:0:1"].cls == "oneway/small"
    assert not any(e.startswith("109") for e in edges)


def test_objects_names_and_issues(dataset):
    items = dataset["scenery"].where("category IN ('buildings', 'mappedObjects', 'objects') OR match_kind = 'tree'").collect()
    kinds = {r.match_kind: r for r in items}
    house = kinds["residential"]
    assert abs(house.match_height - 6.096) < 1e-9 and abs(house.width - 10) < 1e-6 and abs(house.length - 6) < 1e-3
    assert {"tree", "bench", "residential"} == set(kinds)
    label, = dataset["labels"].collect()
    assert (label.name, label.place) == ("Aby", "village")
    assert {r.tag: r.n for r in dataset["unavailable"].collect()} == {"amenity=cafe": 1, "railway=signal": 1}
    reasons = {(r.area, r.reason) for r in dataset["issues"].collect()}
    assert ("relation:202", "cycle") in reasons and ("node:999", "referenced node does not exist") in reasons
    paved = dataset["scenery"].where("cls = 'asphalt'").agg(F.sum(P.signed_area("face"))).first()[0]
    assert abs(paved - 400) < 1e-2


def test_water_kind_order(spark):
    cases = [({"water": "pond", "natural": "water"}, "shallow"), ({"water": "lake", "waterway": "river"}, "shallow"), ({"landuse": "reservoir"}, "lake"),
             ({"natural": "water"}, "water-area"), ({"natural": "spring"}, "metadata-only"), ({"water": "no"}, None), ({"type": "waterway"}, "metadata-only")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tags map<string,string>")
    assert [r.k for r in df.select("i", T.water_kind("tags").alias("k")).orderBy("i").collect()] == [k for _, k in cases]


def test_speeds(spark):
    cases = [("30 mph", 48.28032), ("50 km/h", 50.0), ("50", 50.0), ("signals", None), ("-5", None), ("0", None)]
    df = spark.createDataFrame([(i, {"maxspeed": s}) for i, (s, _) in enumerate(cases)], "i int, tags map<string,string>")
    got = [r.k for r in df.select("i", T.max_speed_kmh("tags").alias("k")).orderBy("i").collect()]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, (_, b) in zip(got, cases))


def test_corridors_of_a_cycle_and_a_spur(spark):
    rows = [(0, 1, 2), (1, 2, 3), (2, 3, 1), (3, 1, 4), (4, 4, 5)]
    df = spark.createDataFrame(rows, "edge_no long, node0 int, node1 int").selectExpr("edge_no", "7 AS way_id", "'road' AS kind", "false AS bridge", "false AS tunnel", "node0", "node1")
    out = N.join_corridors(df).collect()
    lines = {}
    for r in out:
        lines.setdefault(r.line, []).append((r.pos, r.edge_no, r.flipped))
    assert len(lines) == 2 and sum(map(len, lines.values())) == 5
    assert [e for _, e, _ in sorted(lines[3])] == [3, 4] and [p for p, _, _ in sorted(lines[0])] == [0, 1, 2]


def test_terrain_build(spark):
    grid = GridSpec(256.0, 256.0, 65, 65)
    fine = spark.range(65 * 65).selectExpr("0 AS m", "CAST(id / 65 AS BIGINT) AS row", "id % 65 AS col")
    samples = fine.selectExpr("*", "'a' AS source", "1 AS priority", "CASE WHEN (row + col) % 9 = 0 THEN NULL ELSE 100 + row / 2D END AS z").unionByName(
        fine.selectExpr("*", "'b' AS source", "2 AS priority", "CASE WHEN col < 10 THEN 100 + row / 2D END AS z"))
    lake = spark.createDataFrame([("l", -40.0, -40.0, 40.0, -40.0), ("l", 40.0, -40.0, 40.0, 40.0), ("l", 40.0, 40.0, -40.0, 40.0), ("l", -40.0, 40.0, -40.0, -40.0)],
                                 "lake string, x0 double, y0 double, x1 double, y1 double").withColumn("m", F.lit(0))
    out = build_terrain(samples, ["m"], grid, TerrainOptions(water_level=90.0), lakes=lake, biomes=BiomeOptions(water_level=90.0))
    low = out["range"].first()
    assert low.low == 85.0 and out["cells"].where("z IS NULL").count() == 0
    assert out["biomes"].where("biome = 0").count() > 0
