"""Edits of a height grid in a given order: brush strokes, biome paint and graded corridors.

Cells are generated from each stroke or segment, so untouched cells take no part. Raise, lower, flatten
and road grading are affine in the height (z -> a z + b); affine steps of one cell combine in any
grouping, so long histories fold block by block.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from geoloom.functions import faces as P
from geoloom.functions.geo import dist
from geoloom.operators.networks import densify_lines
from geoloom.operators.ordered import BLOCK, block_row_number, block_running_sum, global_row_number, pair_up
from geoloom.operators.raster import cell_x, cell_y, kernel, sample_at_points
from geoloom.operators.tiles import nullable
from geoloom.session import settle, spread
from geoloom.spec import GridSpec


def _bounds(grid: GridSpec, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """First and last row, first and last column of the vertices inside a box."""
    c0 = F.greatest(F.ceil((x0 + grid.width / 2) / grid.dx), F.lit(0)).cast("long")
    c1 = F.least(F.floor((x1 + grid.width / 2) / grid.dx), F.lit(grid.nx - 1)).cast("long")
    r0 = F.greatest(F.ceil((F.lit(grid.height / 2) - y1) / grid.dy), F.lit(0)).cast("long")
    r1 = F.least(F.floor((F.lit(grid.height / 2) - y0) / grid.dy), F.lit(grid.ny - 1)).cast("long")
    return r0, r1, c0, c1


def _span(grid: GridSpec, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Row and column sequences of the vertices inside a box, null when none are."""
    r0, r1, c0, c1 = _bounds(grid, x0, y0, x1, y1)
    return F.when(r0 <= r1, F.sequence(r0, r1)), F.when(c0 <= c1, F.sequence(c0, c1))


def smoothstep(w: Column) -> Column:
    return w * w * (F.lit(3.0) - 2 * w)


def stroke_cells(strokes: DataFrame, grid: GridSpec) -> DataFrame:
    """Vertices within each stroke's radius, with distance d2 from its centre."""
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    rows, cols = _span(grid, x - r, y - r, x + r, y + r)
    out = spread(strokes, ["seq"]).withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
    dx, dy = cell_x(grid) - x, cell_y(grid) - y
    return out.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= r * r)


def affine_fold(steps: DataFrame, by: list[str]) -> DataFrame:
    """Combine ordered affine steps (seq, a, b) of each cell into one: by, row, col, a, b.

    Blocks of the order fold first, so one cell's list is never longer than a block or the block count.
    """
    def combine(rows, order):
        listed = F.array_sort(F.collect_list(F.struct(order, "a", "b")))
        unit = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        total = F.aggregate("_l", unit, lambda s, v: F.struct((s.a * v.a).alias("a"), (s.b * v.a + v.b).alias("b")))
        return rows.agg(listed.alias("_l")).withColumn("_t", total)

    cell = [*by, "row", "col"]
    blocks = combine(steps.withColumn("_blk", F.floor(F.col("seq") / BLOCK)).groupBy(*cell, "_blk"), "seq").select(*cell, "_blk", "_t.a", "_t.b")
    return combine(blocks.groupBy(*cell), "_blk").select(*cell, "_t.a", "_t.b")


def affine_strokes(strokes: DataFrame, grid: GridSpec) -> DataFrame:
    """Raise, lower and flatten strokes as affine steps per cell."""
    rows = stroke_cells(strokes.where("tool <> 'Smooth'"), grid)
    w = smoothstep(F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt("d2") / F.col("radius")))
    pull = w * F.least(F.lit(1.0), F.col("strength"))
    flat = F.col("tool") == "Flatten"
    a = F.when(flat, 1 - pull).otherwise(1.0)
    b = F.when(flat, pull * F.col("target")).when(F.col("tool") == "Raise", w * F.col("strength")).otherwise(-w * F.col("strength"))
    return rows.withColumns({"a": a, "b": b})


def _smooth_stroke(cells: DataFrame, strokes: DataFrame, by: list[str], grid: GridSpec) -> DataFrame:
    """One smoothing stroke per map, from the edited heights around it."""
    sigma = F.greatest(F.lit(0.5), F.col("radius") / min(grid.dx, grid.dy) / 6)
    patch = stroke_cells(strokes.withColumn("sigma", sigma), grid).select(*by, "row", "col", "d2", "radius", "strength", "sigma")
    reach = F.floor(F.col("sigma") * 4 + 0.5).cast("long")
    offsets = F.explode(F.sequence(-reach, reach)).alias("k")
    weight = F.exp(-0.5 * (F.col("k") / F.col("sigma")) ** 2)
    ask = patch.withColumns({"_nr": F.lit(grid.ny).cast("long"), "_nc": F.lit(grid.nx).cast("long")})
    down = ask.select(*by, "row", "col", "sigma", "_nr", "_nc", offsets).withColumn("_w", weight)
    down = down.withColumn("_r", F.least(F.greatest(F.col("row") + F.col("k"), F.lit(0)), F.col("_nr") - 1))
    lines = down.select(*by, F.col("_r").alias("r"), "col", "sigma", "_nc").distinct()
    side = lines.withColumn("reach", F.floor(F.col("sigma") * 4 + 0.5).cast("long")).withColumn("k", F.explode(F.sequence(-F.col("reach"), F.col("reach"))))
    side = side.withColumn("_w", weight).withColumn("_c", F.least(F.greatest(F.col("col") + F.col("k"), F.lit(0)), F.col("_nc") - 1))
    got = side.join(cells.select(*by, F.col("row").alias("r"), F.col("col").alias("_c"), "z"), [*by, "r", "_c"])
    across = got.groupBy(*by, "r", "col").agg((F.sum(F.col("_w") * F.col("z")) / F.sum("_w")).alias("_m"))
    blur = (down.join(across.withColumnRenamed("r", "_r"), [*by, "_r", "col"]).groupBy(*by, "row", "col")
            .agg((F.sum(F.col("_w") * F.col("_m")) / F.sum("_w")).alias("_s")))
    w = smoothstep(F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt("d2") / F.col("radius"))) * F.least(F.lit(1.0), F.col("strength"))
    step = patch.select(*by, "row", "col", w.alias("_w")).join(blur, [*by, "row", "col"])
    return cells.join(step, [*by, "row", "col"], "left").select(
        *by, "row", "col", (F.col("z") + F.coalesce("_w", F.lit(0.0)) * (F.coalesce("_s", F.col("z")) - F.col("z"))).alias("z"))


def apply_strokes(cells: DataFrame, strokes: DataFrame, by: list[str], grid: GridSpec) -> DataFrame:
    """Strokes in sequence. Smoothing reads the edited grid, so it ends a stage; all other strokes of a stage fold at once."""
    smooth = F.when(F.col("tool") == "Smooth", 1).otherwise(0)
    has_smooth = not strokes.where("tool = 'Smooth'").isEmpty()
    if not has_smooth:
        return _fold_into(cells, affine_strokes(strokes, grid), by)
    staged = settle(block_running_sum(strokes, by, ["seq"], smooth, F.floor(F.col("seq") / BLOCK), "stage", dense=False))
    last = int(staged.agg(F.max("stage")).first()[0])
    for stage in range(last + 1):
        part = staged.where(F.col("stage") == stage)
        cells = _fold_into(cells, affine_strokes(part, grid), by)
        cells = settle(_smooth_stroke(settle(cells), part.where("tool = 'Smooth'"), by, grid))
    return cells


def _fold_into(cells: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    # Strokes grow into far more cells than their files let a plan expect, so their fold is never taken for a small table.
    folded = affine_fold(steps, by).hint("merge")
    return cells.join(folded, [*by, "row", "col"], "left").select(
        *by, "row", "col", (F.col("z") * F.coalesce("a", F.lit(1.0)) + F.coalesce("b", F.lit(0.0))).alias("z"))


def paint_latest(strokes: DataFrame, by: list[str], grid: GridSpec) -> DataFrame:
    """Biome of the last paint stamp over each cell."""
    return stroke_cells(strokes, grid).groupBy(*by, "row", "col").agg(F.max_by("biome", "seq").alias("biome"))


def paint_biomes(cells: DataFrame, strokes: DataFrame, by: list[str], grid: GridSpec) -> DataFrame:
    stamp = paint_latest(strokes, by, grid).withColumnRenamed("biome", "_p").hint("merge")
    return cells.join(stamp, [*by, "row", "col"], "left").select(*by, "row", "col", F.coalesce("_p", "biome").alias("biome"))


# ---- corridors ----------------------------------------------------------------------------------------------------

def smooth_along_line(points: DataFrame, keys: list[str], sigma: float, value: str = "z") -> DataFrame:
    """Gaussian of heights along each line (keys, pos), end values repeated outward.

    A line is cut into blocks; a point near a block's border is lent to the neighbour, so windows stay
    within one block however long the line.
    """
    weights = kernel(sigma)
    radius = len(weights) // 2
    if radius == 0:
        return points
    size = max(BLOCK, 4 * radius)
    top = points.groupBy(*keys).agg(F.max("pos").alias("_top"), F.min_by(value, "pos").alias("_first"), F.max_by(value, "pos").alias("_last"))
    blk = F.floor(F.col("pos") / size)
    spread = F.array_distinct(F.array(blk, F.floor((F.col("pos") - radius) / size), F.floor((F.col("pos") + radius) / size)))
    lent = points.withColumn("_own", blk).withColumn("_blk", F.explode(spread)).where("_blk >= 0")
    w = Window.partitionBy(*keys, "_blk").orderBy("pos").rowsBetween(-radius, radius)
    seen = lent.withColumn("_near", F.collect_list(F.struct("pos", F.col(value).alias("v"))).over(w)).where(F.col("_blk") == F.col("_own"))
    rows = seen.join(top, keys)
    table = F.array(*[F.lit(v) for v in weights])
    heads = F.array(*[F.lit(sum(weights[:i])) for i in range(radius + 1)])
    body = F.aggregate("_near", F.lit(0.0), lambda s, p: s + p.v * F.get(table, (p.pos - F.col("pos") + radius).cast("int")))
    left = F.least(F.col("pos"), F.lit(radius)).cast("int")
    right = F.least(F.col("_top") - F.col("pos"), F.lit(radius)).cast("int")
    total = body + F.get(heads, F.lit(radius) - left) * F.col("_first") + F.get(heads, F.lit(radius) - right) * F.col("_last")
    return rows.withColumn(value, total).drop("_own", "_blk", "_near", "_top", "_first", "_last")


def limit_grade(points: DataFrame, keys: list[str], percent: float, value: str = "z") -> DataFrame:
    """Clamp heights along each line to a grade, forward and then backward.

    Each clamp depends on the one before. A line is folded in blocks, one round per block over all lines,
    with the last height of a block carried into the next; most lines end in their first round.
    """
    if percent <= 0:
        return points
    ahead = points.select(*keys, (F.col("pos") - 1).alias("pos"), F.col("x").alias("_nx"), F.col("y").alias("_ny"), F.col(value).alias("_nz"))
    stepped = settle(points.join(ahead, [*keys, "pos"], "left").withColumn("_step", F.coalesce(dist("x", "y", "_nx", "_ny"), F.lit(0.0)) * percent / 100)
                     .drop("_nx", "_ny").withColumn("_blk", F.floor(F.col("pos") / (16 * BLOCK)).cast("long")))
    last = stepped.agg(F.max("_blk")).first()[0]
    if last is None:
        return points
    # Most lines break the grade nowhere and stay as they are; only the others are folded.
    steep = settle(stepped.where(F.abs(F.col("_nz") - F.col(value)) > F.col("_step")).select(*keys).distinct())
    stepped = stepped.drop("_nz")
    calm = stepped.join(steep, keys, "left_anti")
    done = _clamp_rounds(stepped.join(steep, keys, "left_semi"), keys, value, range(int(last) + 1), backward=False)
    done = _clamp_rounds(done, keys, value, range(int(last), -1, -1), backward=True)
    return calm.unionByName(done).drop("_step", "_blk")


def _clamp_rounds(rows: DataFrame, keys: list[str], value: str, blocks, backward: bool) -> DataFrame:
    schema, names = rows.schema, rows.columns
    out, carry = None, None
    for block in blocks:
        part = rows.where(F.col("_blk") == block)
        part = part.join(carry, keys, "left") if carry is not None else part.withColumns({"_ch": F.lit(None).cast("double"), "_cs": F.lit(0.0)})
        order = [*keys, F.desc("pos") if backward else F.asc("pos")]
        done = spread(part, keys).sortWithinPartitions(*order).mapInPandas(_clamp(keys, value, backward, names), schema)
        done = settle(done)
        edge = F.min_by if backward else F.max_by
        carry = done.groupBy(*keys).agg(edge(value, "pos").alias("_ch"), edge("_step", "pos").alias("_cs"))
        out = done if out is None else out.unionByName(done)
    return out


def _clamp(keys: list[str], value: str, backward: bool, names: list[str]):
    """Stream sorted rows and clamp each height to its predecessor; one pass, no group is held."""

    def run(batches):
        line, before, room = None, None, 0.0
        for pdf in batches:
            heights, steps = pdf[value].to_numpy(copy=True), pdf["_step"].to_numpy()
            starts, rooms = pdf["_ch"].to_numpy(), pdf["_cs"].to_numpy()
            for i, key in enumerate(zip(*[pdf[k] for k in keys])):
                if key != line:
                    line = key
                    before, room = (None if starts[i] != starts[i] else starts[i]), rooms[i]
                limit = steps[i] if backward else room
                if before is not None:
                    heights[i] = min(max(heights[i], before - limit), before + limit)
                before, room = heights[i], steps[i]
            yield pdf.assign(**{value: heights})[names]

    return run


def corridor_cells(segments: DataFrame, grid: GridSpec) -> DataFrame:
    """Vertices within half the width plus the blend of each segment: t along it, and weight.

    Segments carry x0..y1, width and blend.
    """
    radius = F.col("width") / 2 + F.col("blend")
    rows, _ = _span(grid, F.least("x0", "x1") - radius, F.least("y0", "y1") - radius, F.greatest("x0", "x1") + radius, F.greatest("y0", "y1") + radius)
    out = spread(segments, ["x0", "y0", "x1", "y1"]).withColumn("row", F.explode(rows))
    # Columns near the stretch of the segment that this row can reach, not its whole box.
    flat = F.abs(F.col("y1") - F.col("y0")) < 1e-9
    share = lambda y: F.least(F.greatest((y - F.col("y0")) / (F.col("y1") - F.col("y0")), F.lit(0.0)), F.lit(1.0))
    x_at = lambda y: F.col("x0") + share(y) * (F.col("x1") - F.col("x0"))
    xa = F.when(flat, F.col("x0")).otherwise(x_at(cell_y(grid) - radius))
    xb = F.when(flat, F.col("x1")).otherwise(x_at(cell_y(grid) + radius))
    c0 = F.greatest(F.ceil((F.least(xa, xb) - radius + grid.width / 2) / grid.dx), F.lit(0)).cast("long")
    c1 = F.least(F.floor((F.greatest(xa, xb) + radius + grid.width / 2) / grid.dx), F.lit(grid.nx - 1)).cast("long")
    # Each of these values is worked out once a row; merged into one expression they would be repeated in every use.
    out = P.steady(out, "_span", F.struct(c0.alias("a"), c1.alias("b")))
    out = out.withColumn("col", F.explode(F.when(F.col("_span.a") <= F.col("_span.b"), F.sequence("_span.a", "_span.b")))).drop("_span")
    vx, vy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    den = vx * vx + vy * vy
    px, py = cell_x(grid) - F.col("x0"), cell_y(grid) - F.col("y0")
    out = P.steady(out.where(den >= 1e-12), "t", F.least(F.greatest((px * vx + py * vy) / den, F.lit(0.0)), F.lit(1.0)))
    out = P.steady(out, "_away", dist(F.col("x0") + F.col("t") * vx, F.col("y0") + F.col("t") * vy, cell_x(grid), cell_y(grid)))
    away = F.col("_away")
    weight = F.when(F.col("blend") > 0, smoothstep(F.least(F.greatest((radius - away) / F.col("blend"), F.lit(0.0)), F.lit(1.0)))).otherwise(
        F.when(away <= F.col("width") / 2, 1.0).otherwise(0.0))
    return P.steady(out, "weight", weight).where("weight > 0").drop("_away")


def grade_corridors(cells: DataFrame, lines: DataFrame, by: list[str], grid: GridSpec, width: float, blend: float, smoothing: float,
                    percent: float, river_depth: float | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """Fit the ground to lines of one kind (by, line, idx, x, y), in line and segment order.

    Profiles come from ``baseline`` (the cells as given, without one), never from edited heights.
    """
    segments = corridor_segments(cells if baseline is None else baseline, lines, by, grid, width, blend, smoothing, percent, river_depth)
    return fold_corridors(cells, segments, by, grid)


def corridor_segments(baseline: DataFrame, lines: DataFrame, by: list[str], grid: GridSpec, width: float, blend: float, smoothing: float,
                      percent: float, river_depth: float | None = None) -> DataFrame:
    """The graded segments of lines of one kind: by, line, pos, x0, y0, z0, x1, y1, z1, width, blend and lower (a river only lowers).

    Segments of a bridge or tunnel are no ground: lines with a true ``structure`` column are left out.
    """
    if "structure" in lines.columns:
        lines = lines.where(~F.coalesce("structure", F.lit(False)))
    step = max(0.1, min(grid.dx, grid.dy, width / 2, 10.0))
    keys = [*by, "line"]
    points = densify_lines(lines, keys, step)
    profile = settle(sample_at_points(baseline, points, by, ["line", "pos", "x", "y"], grid))
    if smoothing > 0:
        profile = smooth_along_line(profile, keys, smoothing / step)
    profile = limit_grade(profile, keys, percent)
    if river_depth is not None:
        profile = profile.withColumn("z", F.col("z") - river_depth)
    return pair_up(profile, keys, "pos", ["x", "y", "z"]).withColumns(
        {"width": F.lit(float(width)), "blend": F.lit(float(blend)), "lower": F.lit(river_depth is not None)})


def fold_corridors(cells: DataFrame, segments: DataFrame, by: list[str], grid: GridSpec, side: int = 32) -> DataFrame:
    """Pull cells toward the corridors of ``segments`` in the order of line and pos: z += weight * (target - z), or toward
    min(z, target) where ``lower`` is true.

    A segment moves once to each tile that it can reach, and never becomes rows of cells. Tiles come as sorted rows, first the cells and
    then the segments; a task holds the heights of one tile and a bounded number of steps, however many segments cross it.
    """
    radius = F.col("width") / 2 + F.col("blend")
    r0, r1, c0, c1 = _bounds(grid, F.least("x0", "x1") - radius, F.least("y0", "y1") - radius, F.greatest("x0", "x1") + radius, F.greatest("y0", "y1") + radius)
    tile = lambda at: F.floor(at / side).cast("long")
    reached = lambda a, b: F.explode(F.when(a <= b, F.sequence(tile(a), tile(b))))
    values = ["x0", "y0", "z0", "x1", "y1", "z1", "width", "blend", "lower"]
    placed = segments.withColumn("_tr", reached(r0, r1)).withColumn("_tc", reached(c0, c1)).select(*by, "_tr", "_tc", "line", "pos", *values)
    ground = cells.select(*by, tile(F.col("row")).alias("_tr"), tile(F.col("col")).alias("_tc"), "row", "col", F.col("z").cast("double").alias("z"))
    keys = [*by, "_tr", "_tc"]
    both = spread(ground.unionByName(placed, allowMissingColumns=True), keys)
    both = both.sortWithinPartitions(*keys, F.col("row").isNull(), "line", "pos", *values)
    schema = StructType([*ground.select(*by, "row", "col").schema.fields, StructField("z", DoubleType())])
    return both.mapInArrow(_tile_fold(by, keys, values, grid, side), schema)


def _tile_fold(by: list[str], keys: list[str], values: list[str], grid: GridSpec, side: int):
    """Stream sorted rows and fold the segments of each tile into its cells."""

    def run(batches):
        here, held, z, corner = None, [], None, (0, 0)

        def finished():
            for rows, at in held:
                yield pa.RecordBatch.from_arrays([*rows.columns, nullable(z[at])], [*by, "row", "col", "z"])

        for batch in batches:
            codes = [pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1 if batch.num_rows else []
            for a, b in pairwise([0, *cuts, batch.num_rows]) if batch.num_rows else ():
                part = batch.slice(a, b - a)
                key = tuple(part.column(k)[0].as_py() for k in keys)
                if key != here:
                    yield from finished()
                    here, held, z, corner = key, [], np.full(side * side, np.nan), (key[-2] * side, key[-1] * side)
                own = part.num_rows - part.column("row").null_count
                if own:
                    rows = part.slice(0, own)
                    at = (rows.column("row").to_numpy() - corner[0]) * side + rows.column("col").to_numpy() - corner[1]
                    z[at] = rows.column("z").to_numpy(zero_copy_only=False)
                    held.append((rows.select([*by, "row", "col"]), at))
                if own < part.num_rows and held:
                    seg = part.slice(own)
                    _fold_segments(z, corner, side, grid, *[seg.column(v).to_numpy(zero_copy_only=False).astype(np.float64) for v in values])
        yield from finished()

    return run


def _fold_segments(z: np.ndarray, corner: tuple[int, int], side: int, grid: GridSpec, *values: np.ndarray, most: int = 1 << 19) -> None:
    """Fold segments in their order into the heights of one tile. Of one cell the steps follow each other; step k of all cells is taken at once."""
    values = np.array(values)
    values = values[:, (values[3] - values[0]) ** 2 + (values[4] - values[1]) ** 2 >= 1e-12]
    x0, y0, _, x1, y1, _, width, blend, _ = values
    radius = width / 2 + blend
    first = lambda v, low: np.clip(np.ceil(v), low, low + side).astype(np.int64)
    after = lambda v, low: np.clip(np.floor(v) + 1, low, low + side).astype(np.int64)
    r0, r1 = first((grid.height / 2 - np.maximum(y0, y1) - radius) / grid.dy, corner[0]), after((grid.height / 2 - np.minimum(y0, y1) + radius) / grid.dy, corner[0])
    c0, c1 = first((np.minimum(x0, x1) - radius + grid.width / 2) / grid.dx, corner[1]), after((np.maximum(x0, x1) + radius + grid.width / 2) / grid.dx, corner[1])
    wide = np.maximum(c1 - c0, 0)
    count = np.maximum(r1 - r0, 0) * wide
    # Segments are taken together up to a number of steps; one alone has at most a tile of them.
    group = (np.cumsum(count) - count) // most
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(group)) + 1), count.size]) if count.size else ():
        n = count[a:b]
        of = np.repeat(np.arange(a, b), n)
        k = np.arange(of.size) - np.repeat(np.cumsum(n) - n, n)
        row, col = r0[of] + k // wide[of], c0[of] + k % wide[of]
        x0, y0, z0, x1, y1, z1, width, blend, lower = values[:, of]
        vx, vy, cx, cy = x1 - x0, y1 - y0, col * grid.dx - grid.width / 2, grid.height / 2 - row * grid.dy
        t = np.clip(((cx - x0) * vx + (cy - y0) * vy) / (vx * vx + vy * vy), 0.0, 1.0)
        dx, dy = cx - (x0 + t * vx), cy - (y0 + t * vy)
        away = np.sqrt(dx * dx + dy * dy)
        share = np.clip((width / 2 + blend - away) / np.where(blend > 0, blend, 1.0), 0.0, 1.0)
        weight = np.where(blend > 0, share * share * (3.0 - 2 * share), away <= width / 2)
        at, target, keep = (row - corner[0]) * side + col - corner[1], z0 + t * (z1 - z0), weight > 0
        at, target, weight, lower = at[keep], target[keep], weight[keep], lower[keep] > 0
        order = np.argsort(at, kind="stable")
        head = np.flatnonzero(np.diff(at[order], prepend=-1))
        turn = np.empty(at.size, np.int64)
        turn[order] = np.arange(at.size) - np.repeat(head, np.diff(head, append=at.size))
        steps = np.argsort(turn, kind="stable")
        for part in np.split(steps, np.cumsum(np.bincount(turn))[:-1]) if at.size else ():
            old = z[at[part]]
            z[at[part]] = old + weight[part] * (np.where(lower[part], np.fmin(old, target[part]), target[part]) - old)


def fold_targets(cells: DataFrame, steps: DataFrame, by: list[str], only_lower: bool = False, block: int = 16 * BLOCK) -> DataFrame:
    """Pull cells toward ordered targets: z += weight * (target - z), or toward min(z, target) where ``lower`` is true.

    Steps of a cell are numbered in the order of ``ord`` (a struct of line and pos, of any type that sorts) and folded a
    block at a time; only a cell with more than one block of steps needs another round.
    """
    cell = [*by, "row", "col"]
    steps = settle(steps if "lower" in steps.columns else steps.withColumn("lower", F.lit(only_lower)))
    lines = global_row_number(steps.select(F.col("ord.line").alias("_line")).distinct(), ["_line"], "_line_no")
    steps = steps.withColumn("_line", F.col("ord.line")).join(lines, "_line").drop("_line")
    numbered = block_row_number(steps, cell, ["ord"], F.col("_line_no"), "_rn")
    steps = settle(numbered.withColumn("_blk", F.floor((F.col("_rn") - 1) / block)).drop("_line_no"))
    last = steps.agg(F.max("_blk")).first()[0]
    rounds = 0 if last is None else int(last) + 1
    for number in range(rounds):
        part = steps.where(F.col("_blk") == number)
        listed = part.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("ord", "weight", "target", "lower"))).alias("_l")).hint("merge")
        goal = lambda z, v: F.when(v.lower, F.least(z, v.target)).otherwise(v.target)
        pulled = F.aggregate(F.col("_l"), F.col("z"), lambda z, v: z + v.weight * (goal(z, v) - z))
        cells = cells.join(listed, cell, "left").select(*cell, F.when(F.col("_l").isNull(), F.col("z")).otherwise(pulled).alias("z"))
        if rounds > 1:
            cells = settle(cells)
    return cells
