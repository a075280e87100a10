"""Resumable application of dataset features, and edits that arrive in order."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from geoloom.operators.editing import apply_strokes
from geoloom.session import settle
from geoloom.spec import GridSpec

KEYS = ["dataset_id", "section", "index"]
BUCKETS = 256


def _wider(schema: StructType, **more) -> StructType:
    return StructType([*schema.fields, *[StructField(name, kind) for name, kind in more.items()]])


def stream_apply_features(features: DataFrame, sink: str, checkpoint: str, step_limit: int | None = None):
    """Write each feature (dataset_id, section, index, ...) once, batch by batch, and journal the ranges.

    A batch lands in a folder named after its number, so a batch repeated after a failure replaces itself. Features
    are stored in buckets of dataset and section, and only the buckets that a batch names are read to leave out
    what earlier batches applied. The checkpoint is the cursor: stopping pauses, starting again resumes. With
    ``step_limit`` a run ends before it would begin one batch more; that batch is left to the next run.
    """
    spark, steps = features.sparkSession, []

    def apply(batch: DataFrame, number: int):
        if step_limit is not None and len(steps) >= step_limit:
            steps.append(None)
            raise RuntimeError("the step limit of this run is reached")
        schema = batch.schema
        once = batch.dropDuplicates(KEYS).withColumn("bucket", F.pmod(F.hash("dataset_id", "section"), F.lit(BUCKETS)))
        named = [r[0] for r in once.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        if number and named:
            stored = spark.read.schema(_wider(schema, batch=LongType(), bucket=IntegerType())).parquet(f"{sink}/features")
            once = once.join(stored.where(F.col("bucket").isin(named) & (F.col("batch") < number)).select(*KEYS), KEYS, "left_anti")
        path = f"{sink}/features/batch={number}"
        once.write.mode("overwrite").partitionBy("bucket").parquet(path)
        landed = spark.read.schema(_wider(schema, bucket=IntegerType())).parquet(path)
        journal = landed.groupBy("dataset_id", "section").agg(F.min("index").alias("first"), F.max("index").alias("last"), F.count(F.lit(1)).alias("entities"))
        journal.withColumn("status", F.lit("applied")).write.mode("overwrite").parquet(f"{sink}/journal/batch={number}")
        steps.append(number)

    query = features.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if None not in steps:
            raise
    return query


def applied_features(spark: SparkSession, sink: str, schema) -> DataFrame:
    """What has been applied so far."""
    return spark.read.schema(schema).parquet(f"{sink}/features").select(*schema.names)


# ---- edits of a stored grid ------------------------------------------------------------------------------------------

def store_cells(cells: DataFrame, path: str, by: list[str], side: int = 32, version: int = 0) -> None:
    """Store a grid (by, row, col, z) as tiles, as version 0 of itself, with the list of each tile's newest version."""
    tiles = cells.withColumns({"tr": F.floor(F.col("row") / side).cast("int"), "tc": F.floor(F.col("col") / side).cast("int")})
    tiles.repartition("tr", "tc").write.mode("overwrite").partitionBy("tr", "tc").parquet(f"{path}/cells/version={version}")
    listed = tiles.select(*by, "tr", "tc").distinct().withColumn("version", F.lit(version).cast("long"))
    listed.write.mode("overwrite").parquet(f"{path}/newest/version={version}")


def _cells(spark: SparkSession, path: str, listed: DataFrame, by: list[str]) -> DataFrame:
    """Cells of the listed tiles in the listed versions; the tile and version folders prune the files.

    ``listed`` is read from files, a row for up to a tile of cells, so that it is the smaller side by size as well as by rows: files of cells are so small for their
    rows that a table of many million cells would be broadcast.
    """
    first = spark.read.parquet(f"{path}/cells/version=0").schema
    plain = [f for f in first.fields if f.name not in ("tr", "tc")]
    schema = _wider(StructType(plain), version=LongType(), tr=IntegerType(), tc=IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/cells").join(listed, [*by, "tr", "tc", "version"])


def stream_strokes(strokes: DataFrame, path: str, by: list[str], grid: GridSpec, checkpoint: str, side: int = 32):
    """Apply brush strokes as they arrive, in seq order within each batch, to a grid stored by ``store_cells``.

    A batch reads and rewrites only the tiles that its strokes, and the surroundings that smoothing looks at, reach.
    Each batch writes its own version folder, so a repeated batch starts from the version before it.
    """
    spark = strokes.sparkSession

    def edit(batch: DataFrame, number: int):
        newest = spark.read.parquet(f"{path}/newest/version={number}")
        sigma = F.greatest(F.lit(0.5), F.col("radius") / min(grid.dx, grid.dy) / 6)
        reach = F.when(F.col("tool") == "Smooth", F.floor(sigma * 4 + 0.5) + 1).otherwise(1)
        row, col = (F.lit(grid.height / 2) - F.col("y")) / grid.dy, (F.col("x") + grid.width / 2) / grid.dx
        tile = lambda at, r, step, n: F.sequence(*[F.floor(F.greatest(F.lit(0), F.least(F.lit(n - 1), at + s * (r / step + reach))) / side).cast("int") for s in (-1, 1)])
        reached = (batch.withColumn("tr", F.explode(tile(row, F.col("radius"), grid.dy, grid.ny))).withColumn("tc", F.explode(tile(col, F.col("radius"), grid.dx, grid.nx)))
                   .select(*by, "tr", "tc").distinct())
        touched = settle(newest.join(reached, [*by, "tr", "tc"]))  # a plan that only guesses its size takes the cells for the smaller table
        apply_strokes(_cells(spark, path, touched, by).drop("tr", "tc", "version"), batch, by, grid).withColumns(
            {"tr": F.floor(F.col("row") / side).cast("int"), "tc": F.floor(F.col("col") / side).cast("int")}).repartition("tr", "tc").write.mode(
            "overwrite").partitionBy("tr", "tc").parquet(f"{path}/cells/version={number + 1}")
        moved = touched.select(*by, "tr", "tc", F.lit(number + 1).cast("long").alias("version"))
        newest.join(reached, [*by, "tr", "tc"], "left_anti").unionByName(moved).write.mode("overwrite").parquet(f"{path}/newest/version={number + 1}")

    query = strokes.writeStream.foreachBatch(edit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_cells(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The newest version of every tile of a stored grid."""
    folder = spark.read.parquet(f"{path}/newest").select(F.max("version").alias("v")).first()[0]
    return _cells(spark, path, spark.read.parquet(f"{path}/newest/version={folder}"), by).drop("tr", "tc", "version")
