"""Streams resume, repeat safely and agree with batch results."""

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators.editing import apply_strokes
from geoloom.spec import GridSpec
from geoloom.streaming.apply import applied_features, latest_cells, store_cells, stream_apply_features, stream_strokes
from geoloom.streaming.ground_grid import stream_ground_grid

def test_features_apply_once_over_restarts(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(40).selectExpr("1L AS dataset_id", "'edges' AS section", "id AS index")
    rows.where("index < 25").write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source)
    stream_apply_features(stream(), sink, str(tmp_path / "cp"))
    rows.where("index >= 20").write.mode("append").parquet(source)  # 20..24 arrive again
    stream_apply_features(stream(), sink, str(tmp_path / "cp"))
    done = applied_features(spark, sink, rows.schema)
    assert done.count() == 40 and done.select("index").distinct().count() == 40
    journal = spark.read.parquet(f"{sink}/journal/batch=*")
    assert journal.agg(F.sum("entities")).first()[0] == 40


def arriving(spark, path, *parts):
    """A stream whose files come one a batch, in this order."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_run_ends_at_its_step_limit(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 2 AS dataset_id", "'edges' AS section", "id AS index")
    stream = arriving(spark, str(tmp_path / "in"), *[rows.where(f"index BETWEEN {a} AND {a + 12}") for a in (0, 10, 20, 30)])
    sink, counts = str(tmp_path / "out"), []
    for _ in range(3):
        stream_apply_features(stream, sink, str(tmp_path / "cp"), step_limit=2)
        counts.append(applied_features(spark, sink, rows.schema).count())
    assert counts == [23, 40, 40]
    assert applied_features(spark, sink, rows.schema).select("index").distinct().count() == 40


def test_points_that_are_not_finite_change_no_cell(spark, tmp_path):
    grid = GridSpec(64.0, 64.0, 17, 17)
    rows = [(0, 0.0, 0.0, 5.0, 2, False), (0, 0.0, 0.0, float("nan"), 2, False), (0, float("nan"), 0.0, 1.0, 2, False), (0, float("inf"), 0.0, 1.0, 2, False), (0, None, 0.0, 1.0, 2, False)]
    df = spark.createDataFrame(rows, "m int, x double, y double, z double, classification int, withheld boolean")
    out = stream_ground_grid(arriving(spark, str(tmp_path / "in"), df), ["m"], grid)
    out.writeStream.format("memory").queryName("ground").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("ground").collect()] == [(0, 8, 8, 5.0, 1)]


def test_strokes_that_arrive_equal_strokes_at_once(spark, tmp_path):
    grid, by = GridSpec(128.0, 128.0, 33, 33), ["m"]
    z = np.random.default_rng(5).normal(size=(2, 33, 33))
    cells = spark.createDataFrame([(m, r, c, float(z[m, r, c])) for m in range(2) for r in range(33) for c in range(33)], "m int, row long, col long, z double")
    tools = [("Raise", 0, 0, 20, 5, 0), ("Smooth", 4, 4, 24, 1, 0), ("Flatten", -50, 40, 16, .5, 3), ("Smooth", -60, 60, 30, .8, 0), ("Lower", 60, -60, 12, 2, 0)]
    rows = [(0, i, t, *map(float, v)) for i, (t, *v) in enumerate(tools)]
    df = spark.createDataFrame(rows, "m int, seq long, tool string, x double, y double, radius double, strength double, target double")
    path = str(tmp_path / "grid")
    store_cells(cells, path, by, 8)
    stream_strokes(arriving(spark, str(tmp_path / "in"), *[df.where(f"seq = {i}") for i in range(5)]), path, by, grid, str(tmp_path / "cp"), 8)
    key = lambda d: {(r.m, r.row, r.col): r.z for r in d.collect()}
    got, want = key(latest_cells(spark, path, by)), key(apply_strokes(cells, df, by, grid))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    written = spark.read.parquet(f"{path}/cells").where("version = 5")
    assert written.select("m").distinct().count() == 1 and written.count() <= 9 * 64
