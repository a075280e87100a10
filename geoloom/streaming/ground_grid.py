"""Ground grids that grow as points arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.operators.raster import ground_cells
from geoloom.spec import GridSpec


def stream_ground_grid(points: DataFrame, by: list[str], grid: GridSpec, ground: int = 2) -> DataFrame:
    """Running sum and count of finite ground heights per cell; use output mode update or complete."""
    return ground_cells(points, by, grid, ground).groupBy(*by, "row", "col").agg(F.sum("z").alias("total"), F.count(F.lit(1)).alias("points"))
