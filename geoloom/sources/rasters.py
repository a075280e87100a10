"""Elevation files: square binary tiles and ASCII grids, one task per file or line."""

from __future__ import annotations

import gzip
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.session import settle
from geoloom.sources.files import write_whole

TILE_NAME = re.compile(r"([NS])(\d{2})([EW])(\d{3})\.hgt(?:\.gz)?$", re.I)
NODATA = -32768
MOST_BYTES = 32 * 1024 * 1024
CELLS = "source string, row long, col long, lat double, lon double, z double"


def tile_origin(name: str) -> tuple[int, int]:
    """South-west corner in degrees, from the file name."""
    found = TILE_NAME.search(name)
    if not found:
        raise ValueError("tile files are named like N59E018.hgt or N59E018.hgt.gz")
    south = int(found[2]) * (-1 if found[1].upper() == "S" else 1)
    west = int(found[4]) * (-1 if found[3].upper() == "W" else 1)
    if not (-90 <= south < 90 and -180 <= west < 180):
        raise ValueError("tile lies outside the world")
    return south, west


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """Cells of square big-endian 16-bit tiles; a tile is at most 3601 x 3601, so one task holds one."""

    def decode(batches):
        for pdf in batches:
            for name, body in zip(pdf["path"], pdf["content"]):
                south, west = tile_origin(name)
                data = bytes(body)
                if name.lower().endswith(".gz"):
                    data = gzip.decompress(data)
                n = math.isqrt(len(data) // 2)
                if len(data) > MOST_BYTES or not 3 <= n <= 3601 or len(data) != 2 * n * n:
                    raise ValueError(f"{name}: not a square grid of 16-bit heights")
                grid = np.frombuffer(data, ">i2").reshape(n, n)
                step = 1 / (n - 1)
                for top in range(0, n, 256):
                    part = grid[top:top + 256]
                    rows, cols = np.divmod(np.arange(part.size), n)
                    rows += top
                    z = part.ravel().astype("float64")
                    yield pd.DataFrame({"source": name.rsplit("/", 1)[-1], "row": rows, "col": cols, "lat": south + 1 - rows * step,
                                        "lon": west + cols * step, "z": np.where(z == NODATA, np.nan, z)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = files.repartition(F.col("path")).mapInPandas(decode, CELLS)
    return cells.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


HEADER = ["ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value"]


def write_grids(cells: DataFrame, folder: str, body) -> DataFrame:
    """One file for each ``source``, which is its name, from cells (source, row, col, z): source and cells of each.

    ``body`` turns an array of heights, nan where there is none, into the file's bytes. A tile is one group.
    """
    def write(table: pa.Table) -> pa.Table:
        rows, cols = table["row"].to_numpy(), table["col"].to_numpy()
        grid = np.full((int(rows.max()) + 1, int(cols.max()) + 1), np.nan)
        grid[rows, cols] = table["z"].to_numpy().astype(np.float64)
        name = table["source"][0].as_py()
        write_whole(f"{folder}/{name}", body(grid))
        return pa.table({"source": [name], "cells": [table.num_rows]})

    return settle(cells.select("source", "row", "col", "z").groupBy("source").applyInArrow(write, "source string, cells long"))


def write_hgt(cells: DataFrame, folder: str) -> DataFrame:
    """Square tiles of big-endian 16-bit heights, void where there is none."""
    return write_grids(cells, folder, lambda grid: np.where(np.isnan(grid), NODATA, grid).astype(">i2").tobytes())


def write_ascii_grid(cells: DataFrame, folder: str, cellsize: float, nodata: float = -9999.0) -> DataFrame:
    """ESRI ASCII grids whose lower left corner is the origin."""
    def body(grid: np.ndarray) -> bytes:
        head = f"ncols {grid.shape[1]}\nnrows {grid.shape[0]}\nxllcorner 0\nyllcorner 0\ncellsize {cellsize}\nNODATA_value {nodata}\n"
        return (head + "".join(" ".join(repr(float(nodata if np.isnan(z) else z)) for z in line) + "\n" for line in grid)).encode()

    return write_grids(cells, folder, body)


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of ESRI ASCII grids: source, row, col, x, y (cell centres) and z.

    The text source splits large files. A line's place is the start of its split and its order within it,
    so row numbers need no whole file in one task.
    """
    from geoloom.operators.ordered import block_row_number

    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("w")).where("w[0] <> ''")
    key = F.lower(F.get("w", F.lit(0)))
    header = lines.where(key.isin(*HEADER)).select("source", key.alias("key"), F.get("w", F.lit(1)).cast("double").alias("v"))
    pick = lambda name: F.max(F.when(F.col("key") == name, F.col("v")))
    spec = header.groupBy("source").agg(*[pick(h).alias(h) for h in HEADER])
    body = lines.where(~key.isin(*HEADER))
    numbered = block_row_number(body, ["source"], ["start", "line"], F.col("start"), "rn")
    cells = numbered.select("source", (F.col("rn") - 1).alias("row"), F.posexplode("w").alias("col", "text")).join(spec, "source")
    half = F.col("cellsize") / 2
    x0 = F.coalesce(F.col("xllcorner") + half, F.col("xllcenter"))
    y0 = F.coalesce(F.col("yllcorner") + half, F.col("yllcenter"))
    z = F.col("text").cast("double")
    return cells.select("source", "row", F.col("col").cast("long").alias("col"), (x0 + F.col("col") * F.col("cellsize")).alias("x"),
                        (y0 + (F.col("nrows") - 1 - F.col("row")) * F.col("cellsize")).alias("y"),
                        F.when(~z.eqNullSafe(F.col("nodata_value")), z).alias("z"))
