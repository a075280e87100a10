"""Grid work on tiles: cells move once, with a border of their neighbours, and arrays do the rest.

A tile is a square of ``SIDE`` cells and the border that its kernel looks at, so a task's memory is that of one tile, whatever the
grid's size. Cells near a side are sent to the neighbour too; results are kept for the tile's own cells only, so there is no seam.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from geoloom.session import settle

SIDE = 256
DEALT = 1 << 18


def _tiles(at: str, border: int, side: int) -> Column:
    """The tiles that see a row or column."""
    return F.explode(F.sequence(F.floor((F.col(at) - border) / side).cast("long"), F.floor((F.col(at) + border) / side).cast("long")))


def _numbers(column) -> np.ndarray:
    return column.to_numpy().astype(np.float64)  # nulls are nan


def nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def array_of(table: pa.Table, value: str, top: int, left: int, height: int, width: int) -> np.ndarray:
    """The cells of a table as an array whose first cell is (top, left); nan where there is none."""
    out = np.full((height, width), np.nan)
    rows, cols = table["row"].to_numpy() - top, table["col"].to_numpy() - left
    out[rows, cols] = _numbers(table[value])
    return out


def over_tiles(cells: DataFrame, by: list[str], value: str, border: tuple[int, int], added: list[str],
               kernel: Callable[[np.ndarray], list[np.ndarray]], side: int = SIDE) -> DataFrame:
    """All columns of ``cells`` and the ``added`` doubles that ``kernel`` computes from an array of ``value``.

    The kernel sees a tile with a border of (rows, columns), nan where there is no cell or value, and returns arrays of the
    same shape. One shuffle moves each cell to its tile, and the few of a border to their neighbours.
    """
    names = cells.columns
    placed = cells.select("*", _tiles("row", border[0], side).alias("_tr")).select("*", _tiles("col", border[1], side).alias("_tc"))

    def work(table: pa.Table) -> pa.Table:
        top, left = table["_tr"][0].as_py() * side, table["_tc"][0].as_py() * side
        rows, cols = table["row"].to_numpy() - top, table["col"].to_numpy() - left
        own = (rows >= 0) & (rows < side) & (cols >= 0) & (cols < side)
        kept = table.select(names).filter(pa.array(own))
        if not own.any():
            results = [np.empty((1, 1))] * len(added)
        else:
            results = kernel(array_of(table, value, top - border[0], left - border[1], side + 2 * border[0], side + 2 * border[1]))
        at = rows[own] + border[0], cols[own] + border[1]
        for name, result in zip(added, results):
            kept = kept.append_column(name, nullable(result[at]))
        return kept

    schema = StructType([*cells.schema.fields, *[StructField(name, DoubleType()) for name in added]])
    return placed.groupBy(*by, "_tr", "_tc").applyInArrow(work, schema)


def repeat_ends(a: np.ndarray, axis: int) -> np.ndarray:
    """The first and last value of every line along ``axis`` repeated outward over nan."""
    a = np.moveaxis(a, axis, 0).copy()
    for order in (range(1, len(a)), range(len(a) - 2, -1, -1)):
        for i in order:
            before = a[i - 1] if order.step > 0 else a[i + 1]
            a[i] = np.where(np.isnan(a[i]), before, a[i])
    return np.moveaxis(a, 0, axis)


def smoothed(a: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """Weights along one axis; the ends of every line count outward."""
    radius = len(weights) // 2
    if radius == 0:
        return a
    full = repeat_ends(a, axis)
    n = a.shape[axis]
    pads = [(radius, radius) if k == axis else (0, 0) for k in range(2)]
    full = np.pad(full, pads, mode="edge")
    out = np.zeros_like(a)
    for k, w in enumerate(weights):
        out += w * (full[k:k + n] if axis == 0 else full[:, k:k + n])
    return np.where(np.isnan(a), np.nan, out)


def gradient(a: np.ndarray, step: float, axis: int) -> np.ndarray:
    """Rise a metre along an axis: central inside, one-sided at borders and gaps, 0 alone."""
    a = np.moveaxis(a, axis, 0)
    around = np.pad(a, ((1, 1), (0, 0)), constant_values=np.nan)
    before, after = around[:-2], around[2:]
    low, high = np.where(np.isnan(before), a, before), np.where(np.isnan(after), a, after)
    low, high = np.where(np.isnan(low), after, low), np.where(np.isnan(high), before, high)
    count = (~np.isnan(before)).astype(int) + ~np.isnan(a) + ~np.isnan(after)
    return np.moveaxis((high - low) / (step * np.maximum(count - 1, 1)), 0, axis)


def sampled(source: DataFrame, targets: DataFrame, by: list[str], ids: list[str], taps: Callable, base: tuple[Column, Column],
            edge: tuple[int, int] | None, side: int = SIDE, dealt: int = DEALT) -> DataFrame:
    """Weighted sums of source cells around fractional places: by, ids, z.

    ``taps`` turns arrays of frow and fcol into (row, column, weight) of each neighbour, at most two cells from ``base``. A tile of
    targets meets the source tile under it; a tile with more than ``dealt`` targets is dealt over several groups.
    """
    border, tile = 2, ["_tr", "_tc"]
    asked = targets.select(*by, *ids, F.col("frow").cast("double").alias("_fr"), F.col("fcol").cast("double").alias("_fc"),
                           F.floor(base[0] / side).cast("long").alias("_tr"), F.floor(base[1] / side).cast("long").alias("_tc"))
    crowds = settle(asked.groupBy(*by, *tile).agg(F.ceil(F.count(F.lit(1)) / dealt).cast("int").alias("_n")).where("_n > 1"))
    asked = asked.join(crowds, [*by, *tile], "left").withColumn("_slot", F.coalesce(F.pmod(F.xxhash64(*ids), F.col("_n")).cast("int"), F.lit(0))).drop("_n")
    # New names for the keys: both sides may stem from one table.
    cells = source.select(*[F.col(c).alias(c) for c in (*by, "row", "col")], F.col("z").cast("double").alias("_z"), _tiles("row", border, side).alias("_tr")).select("*", _tiles("col", border, side).alias("_tc"))
    cells = cells.join(crowds, [*by, *tile], "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1))).drop("_n")
    size = side + 2 * border

    def work(wanted: pa.Table, given: pa.Table) -> pa.Table:
        out = wanted.select([*by, *ids])
        total, weight = np.zeros(wanted.num_rows), np.zeros(wanted.num_rows)
        if given.num_rows and wanted.num_rows:
            top, left = given["_tr"][0].as_py() * side - border, given["_tc"][0].as_py() * side - border
            z = array_of(given, "_z", top, left, size, size)
            for r, c, w in taps(_numbers(wanted["_fr"]), _numbers(wanted["_fc"])):
                if edge:
                    r, c = np.clip(r, 0, edge[0] - 1), np.clip(c, 0, edge[1] - 1)
                seen = z[r.astype(np.int64) - top, c.astype(np.int64) - left]
                there = ~np.isnan(seen) & (w != 0)
                total += np.where(there, w * np.where(there, seen, 0.0), 0.0)
                weight += np.where(there, w, 0.0)
        some = np.abs(weight) > 1e-9
        return out.append_column("z", nullable(np.where(some, total / np.where(some, weight, 1.0), np.nan)))

    fields = {f.name: f for f in targets.schema.fields}
    schema = StructType([*[fields[c] for c in (*by, *ids)], StructField("z", DoubleType())])
    keys = [*by, *tile, "_slot"]
    return asked.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(work, schema)


def nearest_along_rows(lines: DataFrame, by: list[str], dx: float, dy: float, reach: float) -> DataFrame:
    """For every cell of ``lines`` with ``asks``, the nearest of the columns' candidates: by, row, col, d2, vrow, vcol, vz.

    ``lines`` has row, col, asks and the candidate of each column, vr and vz (null where there is none). A line of one grid is one
    group. Columns are tried outward from a cell and it is settled once the next column is farther than what it has,
    so the work follows the distance found and not the reach. Ties go to the smaller row, then column.
    """
    most = reach * reach + 1e-9

    def work(table: pa.Table) -> pa.Table:
        cols, row = table["col"].to_numpy(), table["row"][0].as_py()
        left, n = int(cols.min()), int(cols.max() - cols.min()) + 1
        vr, vz, asks = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, bool)
        real = _numbers(table["vr"])
        vr[cols - left], vz[cols - left] = real, _numbers(table["vz"])
        asks[cols - left] = table["asks"].to_numpy(zero_copy_only=False)
        gy = (vr - row) * dy
        high = np.where(np.isnan(vr), np.inf, gy * gy)
        cells = np.flatnonzero(asks)
        d2, at = np.full(cells.size, np.inf), np.full(cells.size, -1)
        active, step = np.arange(cells.size), 0
        while active.size and step < n:
            gx = step * dx
            active = active[gx * gx <= np.minimum(d2[active], most)]
            for side in (-step, step) if step else (0,):
                other = cells[active] + side
                inside = (other >= 0) & (other < n)
                own, other = active[inside], other[inside]
                dist = gx * gx + high[other]
                best, held = d2[own], at[own]
                tie = (dist == best) & (held >= 0) & ((vr[other] < vr[held]) | ((vr[other] == vr[held]) & (other < held)))
                better = (dist <= most) & ((dist < best) | tie)
                d2[own[better]], at[own[better]] = dist[better], other[better]
            step += 1
        found = at >= 0
        cells, at = cells[found], at[found]
        out = {name: pa.array([table[name][0].as_py()] * cells.size, table.schema.field(name).type) for name in by}
        return pa.table({**out, "row": pa.array(np.full(cells.size, row, np.int64)), "col": pa.array(cells + left), "d2": pa.array(d2[found]),
                         "vrow": pa.array(vr[at].astype(np.int64)), "vcol": pa.array(at + left), "vz": nullable(vz[at])})

    fields = {f.name: f for f in lines.schema.fields}
    long, real = LongType(), DoubleType()
    schema = StructType([*[fields[c] for c in by], StructField("row", long), StructField("col", long), StructField("d2", real), StructField("vrow", long),
                         StructField("vcol", long), StructField("vz", real)])
    return lines.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "asks", "vr", "vz").groupBy(*by, "row").applyInArrow(work, schema)
