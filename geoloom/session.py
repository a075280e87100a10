"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot node, cell or feature is split even where the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Groups are spread over every grouping column, so a hot leading key cannot pin a task.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application."""
    context, root = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_geoloom_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "geoloom.zip")  # read by the driver now and served to every executor
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._geoloom_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local folder only in a local session without one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_dir(spark: SparkSession) -> str:
    """Folder of everything this application settles."""
    return f"{shared_dir(spark)}/geoloom/{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete what this application has settled, once its results are written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame) -> DataFrame:
    """Write a table once into the shared folder and read it back.

    For loops and for tables that several branches read: lineage ends at the files, which outlive any
    executor, and later plans see true sizes and read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


TASK_ROWS = 1 << 21


def roomy(df: DataFrame, keys: list[str], known: int) -> DataFrame:
    """Hash rows ahead of a sort by ``keys`` over more tasks than there are shuffle partitions, where each would sort over ``TASK_ROWS`` of the ``known`` rows.

    A sort that outgrows its task's memory writes its rows once more.
    """
    parts = -(-known // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows over all shuffle partitions, before each of them turns into many rows or much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
