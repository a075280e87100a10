"""Box joins on grid cells of several sizes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions.geo import bbox_touches


LEFT, RIGHT = ("minx", "miny", "maxx", "maxy"), ("rx0", "ry0", "rx1", "ry1")


def _level(box: tuple, cell: float) -> Column:
    """Doublings of ``cell`` until a cell is as wide as the box; 0 for all smaller boxes."""
    side = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1]), F.lit(cell))
    return F.ceil(F.log2(side / cell)).cast("int")


def _levels(*sides: tuple[DataFrame, tuple], cell: float) -> list[int]:
    """The levels that occur: at most one for each doubling between the smallest and the largest box."""
    found = reduce(DataFrame.union, [df.select(_level(box, cell).alias("l")) for df, box in sides]).distinct()
    return sorted(r[0] for r in found.collect() if r[0] is not None)


def in_cells(df: DataFrame, cell: float, levels: list[int], box: tuple = LEFT) -> DataFrame:
    """Repeat each box for the cells it touches (columns _lv, _i, _j) on its own level and on the coarser ones that occur.

    That is at most four cells a level, whatever the size of the box. Two boxes meet on the coarser of their levels,
    where ``_own`` is true for one of them.
    """
    every = F.array(*[F.lit(v) for v in levels]).cast("array<int>")
    rows = df.withColumn("_at", _level(box, cell)).withColumn("_lv", F.explode(F.filter(every, lambda v: v >= F.col("_at"))))
    wide = F.pow(F.lit(2.0), F.col("_lv")) * cell
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / wide).cast("long"), F.floor(F.col(hi) / wide).cast("long")))
    return rows.withColumn("_i", span(box[0], box[2])).withColumn("_j", span(box[1], box[3])).withColumn("_own", F.col("_at") == F.col("_lv")).drop("_at")


def _home(cell: float, x0: tuple, y0: tuple) -> Column:
    """Whether this cell holds the lower corner of the common box, so that a pair is made once."""
    wide = F.pow(F.lit(2.0), F.col("_lv")) * cell
    return (F.floor(F.greatest(*x0) / wide) == F.col("_i")) & (F.floor(F.greatest(*y0) / wide) == F.col("_j"))


def corridor_boxes(corridors: DataFrame, by: list[str], margin: float) -> DataFrame:
    """Padded boxes (bx0..by1) of corridor segments x0,y0,x1,y1."""
    return corridors.select(*by, (F.least("x0", "x1") - margin).alias("bx0"), (F.least("y0", "y1") - margin).alias("by0"),
                            (F.greatest("x0", "x1") + margin).alias("bx1"), (F.greatest("y0", "y1") + margin).alias("by1"))


def reserve_corridors(faces: DataFrame, corridors: DataFrame, by: list[str], face: str, margin: float = 20.0,
                      cell: float = 64.0) -> DataFrame:
    """Faces whose box meets no padded corridor box (x0,y0,x1,y1); both sides carry minx..maxy or ends."""
    return clear_of_boxes(faces, corridor_boxes(corridors, by, margin), by, face, cell)


def clear_of_boxes(faces: DataFrame, boxes: DataFrame, by: list[str], face: str, cell: float = 64.0) -> DataFrame:
    """Faces whose box meets none of the boxes (bx0..by1)."""
    box = ("bx0", "by0", "bx1", "by1")
    levels = _levels((faces, LEFT), (boxes, box), cell=cell)
    left = in_cells(faces.select(*by, face, "minx", "miny", "maxx", "maxy"), cell, levels)
    right = in_cells(boxes, cell, levels, box)
    meet = bbox_touches(("minx", "miny", "maxx", "maxy"), ("bx0", "by0", "bx1", "by1"))
    same = [left["_own"] | right["_own"], *[left[k] == right[k] for k in [*by, "_lv", "_i", "_j"]]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    blocked = left.join(right, cond & meet, "left_semi").select(*by, face).distinct()
    return faces.join(blocked, [*by, face], "left_anti")


CELLS = 1 << 22  # cells of a cover: its two bits for each of them take a megabyte
EDGE = 1e-6      # share of a cell by which a cover is careful, far more than rounding can move


@dataclass(frozen=True)
class Cover:
    """Square cells of a centred map: ``full`` ones lie in one box whole, and no box reaches those that are not ``met``.

    So what touches a full cell touches a box, and what lies in cells that are not met touches none. Only faces between, at the rim of what the boxes
    cover together, have to be compared with boxes. The number of cells is bounded, whatever the number of boxes.
    """

    width: float
    height: float
    cell: float
    full: bytes
    met: bytes

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of full and of met cells below and left of each corner."""
        nx, ny = _sides(self.width, self.height, self.cell)
        bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8), count=nx * ny).reshape(ny, nx)
        return tuple(np.pad(bits(b).cumsum(0, np.int32).cumsum(1, np.int32), ((1, 0), (1, 0))) for b in (self.full, self.met))

    def spans(self, x0, y0, x1, y1) -> tuple[np.ndarray, ...]:
        """First column and row of boxes, and those after the last."""
        at = lambda v, size: np.floor((v + size / 2) / self.cell).astype(np.int64)
        return at(x0, self.width), at(y0, self.height), at(x1, self.width) + 1, at(y1, self.height) + 1


def held(table: np.ndarray, i0, j0, i1, j1) -> np.ndarray:
    """Cells that a table of ``Cover.tables`` counts in columns i0..i1 and rows j0..j1, the last ones left out."""
    (i0, i1), (j0, j1) = (np.clip(v, 0, table.shape[1] - 1) for v in (i0, i1)), (np.clip(v, 0, table.shape[0] - 1) for v in (j0, j1))
    return table[j1, i1] - table[j0, i1] - table[j1, i0] + table[j0, i0]


def _sides(width: float, height: float, cell: float) -> tuple[int, int]:
    return int(width // cell) + 1, int(height // cell) + 1


def _ends(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("bx0", "by0", "bx1", "by1")]


def cover_of(boxes: DataFrame, width: float, height: float, least: float = 1.0) -> Cover:
    """Cover of a map by boxes (bx0..by1), with cells of ``least`` metres or, on a large map, as many as ``CELLS``.

    A task sums its boxes over the map in one table and sends a row of bits for each row of cells; those are united before they reach the driver.
    """
    cell = max(least, (width * height / CELLS) ** 0.5 * 1.01)
    nx, ny = _sides(width, height, cell)

    def mark(batches):
        tables = np.zeros((2, (ny + 1) * (nx + 1)), np.int32)
        for batch in batches:
            x0, y0, x1, y1 = ends = _ends(batch)
            sound = np.all(np.isfinite(ends), 0)
            # Far outside of the map is as good as just outside.
            x0, x1 = ((np.clip(v[sound], -width, width) + width / 2) / cell for v in (x0, x1))
            y0, y1 = ((np.clip(v[sound], -height, height) + height / 2) / cell for v in (y0, y1))
            for table, i0, j0, i1, j1 in ((tables[0], np.ceil(x0 + EDGE), np.ceil(y0 + EDGE), np.floor(x1 - EDGE), np.floor(y1 - EDGE)),
                                          (tables[1], np.floor(x0 - EDGE), np.floor(y0 - EDGE), np.floor(x1 + EDGE) + 1, np.floor(y1 + EDGE) + 1)):
                (i0, i1), (j0, j1) = ([np.clip(v, 0, n).astype(np.int64) for v in w] for w, n in (((i0, i1), nx), ((j0, j1), ny)))
                some = (i0 < i1) & (j0 < j1)
                for i, j, n in ((i0, j0, 1), (i1, j0, -1), (i0, j1, -1), (i1, j1, 1)):
                    np.add.at(table, j[some] * (nx + 1) + i[some], n)
        full, met = (t.reshape(ny + 1, nx + 1).cumsum(0).cumsum(1)[:ny, :nx] > 0 for t in tables)
        rows = np.flatnonzero(met.any(1))
        if rows.size:
            yield packed(rows, full[rows], met[rows])

    def packed(rows, full, met):
        bits = lambda b: pa.array([r.tobytes() for r in np.packbits(b, axis=1)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), bits(full), bits(met)], ["row", "full", "met"])

    def unite(batches):
        rows = {}
        for batch in batches:
            for row, *bits in zip(*(c.to_pylist() for c in batch.columns)):
                bits = np.stack([np.frombuffer(b, np.uint8) for b in bits])
                rows[row] = bits | rows[row] if row in rows else bits
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array([b[i].tobytes() for b in rows.values()], pa.binary()) for i in (0, 1))],
                                             ["row", "full", "met"])

    schema = "row int, full binary, met binary"
    full, met = np.zeros((2, ny, nx), bool)
    for row, *bits in boxes.select("bx0", "by0", "bx1", "by1").mapInArrow(mark, schema).repartition("row").mapInArrow(unite, schema).collect():  # two bits a cell
        full[row], met[row] = (np.unpackbits(np.frombuffer(b, np.uint8), count=nx) for b in bits)
    return Cover(width, height, cell, np.packbits(full).tobytes(), np.packbits(met).tobytes())


def boxes_at_rim(boxes: DataFrame, cover: Cover) -> DataFrame:
    """Boxes that reach a cell of the map that is not full; no others can touch a face that touches no full cell."""
    names = boxes.columns

    def run(batches):
        full = cover.tables()[0]
        ny, nx = (n - 1 for n in full.shape)
        for batch in batches:
            ends = _ends(batch)
            sound = np.all(np.isfinite(ends), 0)
            x, y = cover.width, cover.height
            span = cover.spans(*(np.clip(np.where(sound, v, 0), -s, s) + e for v, s, e in zip(ends, (x, y, x, y), np.array([-EDGE, -EDGE, EDGE, EDGE]) * cover.cell)))
            wide = (np.clip(span[2], 0, nx) - np.clip(span[0], 0, nx)) * (np.clip(span[3], 0, ny) - np.clip(span[1], 0, ny))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(~sound | (held(full, *span) < wide))) for c in names], names)

    return boxes.mapInArrow(run, boxes.schema)


def patch_overlaps(patches: DataFrame, by: list[str], cell: float = 64.0) -> DataFrame:
    """Pairs of patches (a < b) that overlap, each with its own margin around length x width.

    A pair is reported only in the cell that holds the lower corner of its common box, so no later
    distinct is needed.
    """
    hx, hy = F.col("length") / 2 + F.col("margin"), F.col("width") / 2 + F.col("margin")
    boxed = patches.select(*by, "id", (F.col("x") - hx).alias("minx"), (F.col("y") - hy).alias("miny"), (F.col("x") + hx).alias("maxx"),
                           (F.col("y") + hy).alias("maxy"))
    cells = in_cells(boxed, cell, _levels((boxed, LEFT), cell=cell))
    name = lambda p: cells.select(*by, "_lv", "_i", "_j", *[F.col(c).alias(p + c) for c in ("id", "_own", *LEFT)])
    pairs = name("a_").join(name("b_"), [*by, "_lv", "_i", "_j"]).where("(a__own OR b__own) AND a_id < b_id AND a_minx < b_maxx AND a_maxx > b_minx AND a_miny < b_maxy AND a_maxy > b_miny")
    return pairs.where(_home(cell, ("a_minx", "b_minx"), ("a_miny", "b_miny"))).select(*by, F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def bbox_overlap_join(extents: DataFrame, requests: DataFrame, closed: bool, cell: float = 1.0) -> DataFrame:
    """Extents met by request boxes (rx0..ry1), by shared cells; reported once per pair."""
    levels = _levels((extents, LEFT), (requests, RIGHT), cell=cell)
    left = in_cells(extents, cell, levels)
    right = in_cells(requests, cell, levels, RIGHT).withColumnRenamed("_own", "_mine")
    if closed:
        meet = "minx <= rx1 AND maxx >= rx0 AND miny <= ry1 AND maxy >= ry0"
    else:
        meet = "minx < rx1 AND maxx > rx0 AND miny < ry1 AND maxy > ry0"
    met = left.join(right, ["_lv", "_i", "_j"]).where("_own OR _mine").where(meet)
    return met.where(_home(cell, ("minx", "rx0"), ("miny", "ry0"))).drop("_lv", "_i", "_j", "_own", "_mine")
