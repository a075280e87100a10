"""Height grids as rows (by..., row, col, z): sampling, filling, smoothing, burning and encoding.

Row 0 is north and vertices lie on the map corners. Windows run along one row or column of one grid, so they
hold at most a grid's longer side, whatever the number of grids.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.functions.tags import unit_multiplier
from geoloom.operators.tiles import gradient, nearest_along_rows, over_tiles, sampled, smoothed
from geoloom.operators.tiling import points_in_boxes
from geoloom.session import settle
from geoloom.spec import GridSpec


def vertices(spark, grid: GridSpec) -> DataFrame:
    rows = spark.range(grid.nx * grid.ny)
    return rows.select((F.col("id") / grid.nx).cast("long").alias("row"), (F.col("id") % grid.nx).alias("col"))


def cell_x(grid: GridSpec) -> Column:
    return F.col("col") * grid.dx - grid.width / 2


def cell_y(grid: GridSpec) -> Column:
    return F.lit(grid.height / 2) - F.col("row") * grid.dy


# ---- sources ------------------------------------------------------------------------------------------------

def ground_cells(points: DataFrame, by: list[str], grid: GridSpec, ground: int = 2) -> DataFrame:
    """Cell and height of each finite, classified ground point on the grid: by, row, col, z."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    left, top = -grid.width / 2 - grid.dx / 2, grid.height / 2 + grid.dy / 2
    keep = ((F.col("classification") == ground) & ~F.col("withheld") & fine("x") & fine("y") & fine("z") & (F.col("x") >= left)
            & (F.col("x") < grid.width / 2 + grid.dx / 2) & (F.col("y") > -grid.height / 2 - grid.dy / 2) & (F.col("y") <= top))
    row, col = F.floor((F.lit(top) - F.col("y")) / grid.dy).cast("long"), F.floor((F.col("x") - left) / grid.dx).cast("long")
    rows = points.where(keep).select(*by, row.alias("row"), col.alias("col"), F.col("z").cast("double").alias("z"))
    inside = F.col("row").between(0, grid.ny - 1) & F.col("col").between(0, grid.nx - 1)
    return rows.where(inside)


def grid_ground_points(points: DataFrame, by: list[str], grid: GridSpec, ground: int = 2) -> DataFrame:
    """Mean height and count of classified ground points per cell; other classes never stand in."""
    return ground_cells(points, by, grid, ground).groupBy(*by, "row", "col").agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("points"))


def ground_stats(points: DataFrame, gridded: DataFrame, by: list[str], grid: GridSpec) -> DataFrame:
    scanned = points.groupBy(*by).agg(F.count(F.lit(1)).alias("scanned"))
    filled = gridded.groupBy(*by).agg(F.sum("points").alias("selected"), F.count(F.lit(1)).alias("_cells"))
    return scanned.join(filled, by, "left").select(*by, "scanned", F.coalesce("selected", F.lit(0)).alias("selected"),
                                                   (F.lit(grid.nx * grid.ny) - F.coalesce("_cells", F.lit(0))).alias("unfilled"))


def calibrate(z, scale, offset, units, selection: str = "Auto / metres") -> Column:
    """Stored value to metres; anything not finite is missing."""
    value = (F.col(z) * F.col(scale) + F.col(offset)) * unit_multiplier(units, selection)
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def apply_mask(cells: DataFrame, mask: DataFrame | None, by: list[str], nodata: Column) -> DataFrame:
    """An explicit mask decides alone, in both directions; without one the nodata value does."""
    if mask is None:
        return cells.withColumn("z", F.when(F.col("z") != nodata, F.col("z")))
    return cells.join(mask.select(*by, "row", "col", "valid"), [*by, "row", "col"], "left").withColumn(
        "z", F.when(F.coalesce("valid", F.lit(True)), F.col("z"))).drop("valid")


def crop_window(cells: DataFrame, r0: float, r1: float, c0: float, c1: float, halo: int = 3) -> DataFrame:
    """Source cells a target needs, with neighbours for interpolation; a plain range filter that reaches the scan."""
    return cells.where(F.col("row").between(math.floor(r0) - halo, math.ceil(r1) + halo - 1)
                       & F.col("col").between(math.floor(c0) - halo, math.ceil(c1) + halo - 1))


def first_valid(samples: DataFrame, by: list[str]) -> DataFrame:
    """Height of the best source with one, per cell: z, source."""
    best = samples.where("z IS NOT NULL").groupBy(*by, "row", "col").agg(F.min_by(F.struct("z", "source"), "priority").alias("b"))
    return best.select(*by, "row", "col", "b.z", "b.source")


def source_contribution(samples: DataFrame, chosen: DataFrame, by: list[str], total: int) -> DataFrame:
    have = samples.where("z IS NOT NULL").groupBy(*by, "source").agg(F.count(F.lit(1)).alias("available"))
    won = chosen.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("contributed"))
    n = F.coalesce("contributed", F.lit(0))
    return have.join(won, [*by, "source"], "left").select(*by, "source", "available", n.alias("contributed"), (n * 100.0 / total).alias("percent"))


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Convolution weights (a = -0.5) of the four neighbours at -1, 0, 1, 2 for an offset t."""
    near = lambda d: 1.5 * d * d * d - 2.5 * d * d + 1
    far = lambda d: -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def _taps(method: str):
    """Function of fractional rows and columns that lists their neighbours and weights."""
    def nearest(fr, fc):
        yield np.floor(fr + 0.5), np.floor(fc + 0.5), np.ones(fr.size)

    def weighted(fr, fc):
        r0, c0 = np.floor(fr), np.floor(fc)
        t, u = fr - r0, fc - c0
        wr, wc, first = ([1 - t, t], [1 - u, u], 0) if method == "Bilinear" else (_cubic(t), _cubic(u), -1)
        for i, a in enumerate(wr):
            for j, b in enumerate(wc):
                yield r0 + (first + i), c0 + (first + j), a * b

    return nearest if method == "Nearest" else weighted


def resample_grid(source: DataFrame, targets: DataFrame, by: list[str], ids: list[str], method: str = "Bilinear",
                  edge: tuple[int, int] | None = None) -> DataFrame:
    """Source heights at fractional places (frow, fcol): by, ids, z.

    Targets meet the source tile under them, once each. Weights are renormalised over the neighbours that exist; none gives null.
    ``edge`` (rows, columns) repeats the border outward instead. Null places give null.
    """
    base = [F.floor(F.col(c) + (0.5 if method == "Nearest" else 0.0)) for c in ("frow", "fcol")]
    if edge:
        base = [F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)) for v, n in zip(base, edge)]
    placed = targets.where("frow IS NOT NULL AND fcol IS NOT NULL AND NOT isnan(frow) AND NOT isnan(fcol)")
    out = sampled(source, placed, by, ids, _taps(method), tuple(base), edge)
    lost = targets.where("frow IS NULL OR fcol IS NULL OR isnan(frow) OR isnan(fcol)")
    return out.unionByName(lost.select(*by, *ids, F.lit(None).cast("double").alias("z")))


def sample_at_points(cells: DataFrame, points: DataFrame, by: list[str], ids: list[str], grid: GridSpec) -> DataFrame:
    """Bilinear height at world points; outside, the border holds."""
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n - 1)))
    fcol = clamp((F.col("x") / grid.width + 0.5) * (grid.nx - 1), grid.nx)
    frow = clamp((F.lit(0.5) - F.col("y") / grid.height) * (grid.ny - 1), grid.ny)
    return resample_grid(cells, points.withColumns({"frow": frow, "fcol": fcol}), by, ids, "Bilinear", (grid.ny, grid.nx))


def lattice_neighbours(sources: DataFrame, by: list[str]) -> DataFrame:
    """Number runs of consecutive sources that share one lattice (column mosaic), in priority order.

    Same spacing, whole-cell offset, CRS, calibration and datum. A map has few hundred sources at most.
    """
    keys = ["dx", "dy", "crs", "scale", "off", "factor", "datum"]
    order = Window.partitionBy(*by).orderBy("priority")
    head = lambda c: F.lag(c).over(order)
    same = F.lit(True)
    for k in ("crs", "scale", "off", "factor", "datum"):
        same = same & F.col(k).eqNullSafe(head(k))
    for k in ("dx", "dy"):
        same = same & (F.abs(F.col(k) - head(k)) <= 1e-12 * F.abs(F.col(k)) + 1e-12)
    for o, d in (("x0", "dx"), ("y0", "dy")):
        shift = (F.col(o) - head(o)) / F.col(d)
        same = same & (F.abs(shift - F.rint(shift)) <= 1e-7)
    fresh = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    run = sources.withColumn("_f", fresh)
    return run.withColumn("mosaic", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def mosaic_sources(cells: DataFrame, sources: DataFrame, targets: DataFrame, by: list[str], method: str = "Bilinear"):
    """Heights at map vertices from several sources: (heights with source, contribution samples).

    Sources on one lattice are joined before interpolation, so no seam shows; coverage is still counted for
    each original file. ``cells``: by, source, row, col, z (calibrated). ``sources``: by, source, priority, lattice
    columns. ``targets``: by, row, col, x, y in source coordinates.
    """
    numbered = lattice_neighbours(sources, by)
    head = numbered.groupBy(*by, "mosaic").agg(F.min_by("x0", "priority").alias("hx"), F.min_by("y0", "priority").alias("hy"))
    placed = numbered.join(head, [*by, "mosaic"])
    # One table of own-lattice samples per source, for coverage.
    # A target asks only the sources whose cells, with room for the widest kernel, reach it.
    lattice = [*by, "source", "priority", "mosaic", "x0", "y0", "dx", "dy", "hx", "hy"]
    spread_of = cells.groupBy(*by, "source").agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1"))
    edge = lambda o, d, at: F.col(o) + F.col(d) * at
    ya, yb, xa, xb = edge("y0", "dy", F.col("_r0") - 3), edge("y0", "dy", F.col("_r1") + 4), edge("x0", "dx", F.col("_c0") - 3), edge("x0", "dx", F.col("_c1") + 4)
    boxes = settle(placed.select(*lattice).join(spread_of, [*by, "source"]).select(
        *lattice, F.least(ya, yb).alias("_s"), F.least(xa, xb).alias("_w"), F.greatest(ya, yb).alias("_n"), F.greatest(xa, xb).alias("_e")))
    asks = points_in_boxes(targets, boxes, [c for c in lattice if c not in by], tuple(by), ("y", "x"), ("_s", "_w", "_n", "_e"))
    frac = lambda o, d, v: (F.col(v) - F.col(o)) / F.col(d) - 0.5
    own_targets = asks.select(*by, "source", F.col("row").alias("trow"), F.col("col").alias("tcol"),
                              frac("y0", "dy", "y").alias("frow"), frac("x0", "dx", "x").alias("fcol"))
    own = resample_grid(cells, own_targets, [*by, "source"], ["trow", "tcol"], method)
    joined = cells.join(placed.select(*by, "source", "mosaic", "priority", "x0", "y0", "dx", "dy", "hx", "hy"), [*by, "source"])
    joined = joined.select(*by, "mosaic", "priority", F.lit("").alias("source"), "z",
                           (F.col("row") + F.rint((F.col("y0") - F.col("hy")) / F.col("dy")).cast("long")).alias("row"),
                           (F.col("col") + F.rint((F.col("x0") - F.col("hx")) / F.col("dx")).cast("long")).alias("col"))
    shared = first_valid(joined, [*by, "mosaic"]).drop("source")
    mos_targets = asks.select(*by, "mosaic", F.col("row").alias("trow"), F.col("col").alias("tcol"),
                              frac("hy", "dy", "y").alias("frow"), frac("hx", "dx", "x").alias("fcol")).distinct()
    smooth = resample_grid(shared, mos_targets, [*by, "mosaic"], ["trow", "tcol"], method).withColumnRenamed("z", "mz")
    samples = (own.join(placed.select(*by, "source", "priority", "mosaic"), [*by, "source"])
               .withColumnsRenamed({"trow": "row", "tcol": "col"}))
    won = first_valid(samples, by)
    out = (won.join(placed.select(*by, "source", "mosaic"), [*by, "source"])
           .join(smooth.withColumnsRenamed({"trow": "row", "tcol": "col"}), [*by, "mosaic", "row", "col"], "left")
           .select(*by, "row", "col", F.coalesce("mz", "z").alias("z"), "source"))
    return out, samples


# ---- gaps, smoothing, slope ------------------------------------------------------------------------------------

def nearest_valid(cells: DataFrame, by: list[str], valid: Column, dx: float, dy: float, reach: float) -> DataFrame:
    """For every cell that is not valid, the nearest valid one within ``reach`` metres: d2, vrow, vcol, vz.

    First the nearest valid cell up and down each column, by one window; then every row that has a gap settles its cells over all
    columns at once. No cell is repeated, however far the reach. Ties go to the smaller row, then column.
    """
    flagged = cells.withColumn("_ok", valid)
    column = Window.partitionBy(*by, "col").orderBy("row")
    up, down = column.rowsBetween(Window.unboundedPreceding, 0), column.rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col("_ok"), F.struct(F.col("row").alias("r"), F.col("z").alias("z")))
    near = flagged.withColumns({"_u": F.last(mark, True).over(up), "_d": F.first(mark, True).over(down)})
    # Of a column's two the nearer counts, the upper one where they tie.
    upper = F.col("_d").isNull() | (F.col("row") - F.col("_u.r") <= F.col("_d.r") - F.col("row"))
    lines = near.select(*by, "row", "col", (~F.col("_ok")).alias("asks"), F.when(F.col("_u").isNotNull() & upper, F.col("_u")).otherwise(F.col("_d")).alias("_v"))
    # A grid whose last row is unfinished: columns that end early stand for the rows below their end.
    ends = near.groupBy(*by, "col").agg(F.max("row").alias("_end"), F.max_by("_u", "row").alias("_v"))
    bottom = ends.groupBy(*by).agg(F.max("_end").alias("_bottom"))
    short = ends.join(bottom, by) if by else ends.join(bottom, F.lit(True))
    short = short.where("_end < _bottom AND _v IS NOT NULL").select(*by, F.explode(F.sequence(F.col("_end") + 1, F.col("_bottom"))).alias("row"),
                                                                    "col", F.lit(False).alias("asks"), "_v")
    lines = lines.unionByName(short).select(*by, "row", "col", "asks", F.col("_v.r").alias("vr"), F.col("_v.z").cast("double").alias("vz"))
    # Lines without a gap end here; the window deals rows as the search needs them.
    wanting = lines.withColumn("_some", F.max("asks").over(Window.partitionBy(*by, "row"))).where("_some").drop("_some")
    return nearest_along_rows(wanting, by, dx, dy, reach)


def fill_gaps(cells: DataFrame, by: list[str], dx: float, dy: float, reach: float) -> DataFrame:
    """Missing heights from the nearest valid cell within ``reach``; farther gaps stay null. Adds filled_from."""
    near = nearest_valid(cells, by, F.col("z").isNotNull(), dx, dy, reach)
    out = cells.join(near, [*by, "row", "col"], "left")
    return out.select(*by, "row", "col", F.coalesce("z", "vz").alias("z"), F.sqrt("d2").alias("filled_from"))


def gap_stats(before: DataFrame, filled: DataFrame, by: list[str]) -> DataFrame:
    """Missing and filled counts, the farthest fill, and whether a gap is too wide or all is missing."""
    lost = before.groupBy(*by).agg(F.count_if(F.col("z").isNull()).alias("missing"), F.count(F.lit(1)).alias("cells"))
    done = filled.groupBy(*by).agg(F.count("filled_from").alias("filled"), F.max("filled_from").alias("farthest"))
    state = (F.when(F.col("missing") == F.col("cells"), "no elevation").when(F.col("missing") > F.col("filled"), "gap too wide").otherwise("ok"))
    return lost.join(done, by).select(*by, "missing", "filled", F.coalesce("farthest", F.lit(0.0)).alias("farthest"), state.alias("state"))


def kernel(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [v / total for v in raw]


def gaussian_smooth(cells: DataFrame, by: list[str], sigma_rows: float, sigma_cols: float) -> DataFrame:
    """Separable Gaussian over a gap-free grid; sigmas in cells. The ends of every line count outward."""
    down, across = kernel(sigma_rows), kernel(sigma_cols)
    border = (len(down) // 2, len(across) // 2)
    if border == (0, 0):
        return cells
    out = over_tiles(cells, by, "z", border, ["_smooth"], lambda a: [smoothed(smoothed(a, across, 1), down, 0)])
    return out.withColumn("z", F.col("_smooth")).drop("_smooth")


def with_gradient(cells: DataFrame, by: list[str], dx: float, dy: float) -> DataFrame:
    """Add _gx and _gy: rise per metre to the east and to the south, central inside and one-sided at borders."""
    return over_tiles(cells, by, "z", (1, 1), ["_gx", "_gy"], lambda a: [gradient(a, dx, 1), gradient(a, dy, 0)])


def terrain_slope(cells: DataFrame, by: list[str], dx: float, dy: float) -> DataFrame:
    """Slope in degrees from central differences, one-sided at borders."""
    rows = with_gradient(cells, by, dx, dy)
    return rows.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)))).drop("_gx", "_gy")


# ---- burning and encoding ---------------------------------------------------------------------------------------

def rasterize_polygons(edges: DataFrame, polygon: str, values: DataFrame, grid: GridSpec, by: list[str] | None = None) -> DataFrame:
    """Cells whose vertex lies in a polygon, holes open; the later polygon wins: by, row, col, value.

    Each edge toggles the cells left of its crossing on every row it spans. Toggles of one polygon, row
    and column cancel in pairs before they meet, so a row holds at most one toggle per column.
    ``values`` has the polygon key, value and ord.
    """
    by = by or []
    ymin, ymax = F.least("y0", "y1"), F.greatest("y0", "y1")
    top = grid.height / 2
    low = F.greatest(F.floor((F.lit(top) - ymax) / grid.dy) + 1, F.lit(0)).cast("int")
    high = F.least(F.floor((F.lit(top) - ymin) / grid.dy), F.lit(grid.ny - 1)).cast("int")
    rows = edges.where("y0 <> y1").select(*by, polygon, "x0", "y0", "x1", "y1", F.explode(F.when(low <= high, F.sequence(low, high))).alias("row"))
    y = F.lit(top) - F.col("row") * grid.dy
    cross = F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    at = F.least(F.greatest(F.ceil((cross + grid.width / 2) / grid.dx), F.lit(0)), F.lit(grid.nx)).cast("long")
    toggles = (rows.select(*by, polygon, F.col("row").cast("long").alias("row"), at.alias("at")).groupBy(*by, polygon, "row", "at")
               .agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1"))
    w = Window.partitionBy(*by, polygon, "row").orderBy("at")
    runs = toggles.select(*by, polygon, "row", "at", F.lead("at").over(w).alias("until"), F.row_number().over(w).alias("i")).where("i % 2 = 1 AND until > at")
    cells = runs.join(values, polygon).select(*by, "row", F.explode(F.sequence(F.col("at"), F.col("until") - 1)).alias("col"), "value", "ord")
    return cells.groupBy(*by, "row", "col").agg(F.max_by("value", "ord").alias("value"))


def carve_lakes(cells: DataFrame, mask: DataFrame, by: list[str], dx: float, dy: float, bed: float, feather: float) -> DataFrame:
    """Lower masked cells to the bed, eased in over ``feather`` metres from the shore."""
    wet = cells.join(mask.select(*by, "row", "col", F.lit(True).alias("wet")), [*by, "row", "col"], "left").withColumn("wet", F.coalesce("wet", F.lit(False)))
    if feather > 0:
        shore = nearest_valid(wet, by, ~F.col("wet"), dx, dy, feather).select(*by, "row", "col", "d2")
        wet = wet.join(shore, [*by, "row", "col"], "left")
        weight = F.when(F.col("wet"), F.coalesce(F.least(F.lit(1.0), F.sqrt("d2") / feather), F.lit(1.0))).otherwise(0.0)
    else:
        weight = F.when(F.col("wet"), 1.0).otherwise(0.0)
    return wet.select(*by, "row", "col", (F.col("z") + weight * (F.least(F.col("z"), F.lit(float(bed))) - F.col("z"))).alias("z"))


def elevation_range(cells: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    both = cells.join(baseline.select(*by, "row", "col", F.col("z").alias("_b")), [*by, "row", "col"])
    return both.groupBy(*by).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.max(F.abs(F.col("z") - F.col("_b"))).alias("largest_change"))


def encode_heights(cells: DataFrame, by: list[str], manual: tuple[float, float] | None = None, clip: bool = True) -> DataFrame:
    """16-bit codes over a whole-metre (or given) range, rounding halves to even; adds lo, hi, clipped.

    Without ``clip`` a height outside a given range is an error.
    """
    if manual:
        spans = cells.withColumns({"lo": F.lit(float(manual[0])), "hi": F.lit(float(manual[1]))})
    else:
        span = cells.groupBy(*by).agg(F.floor(F.min("z")).alias("lo"), F.ceil(F.max("z")).alias("_h"))
        spans = cells.join(span.select(*by, "lo", F.when(F.col("lo") == F.col("_h"), F.col("lo") + 1).otherwise(F.col("_h")).alias("hi")), by)
    part = (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    code = F.rint(F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)) * 65535).cast("int")
    outside = (F.col("z") < F.col("lo")) | (F.col("z") > F.col("hi"))
    if not clip:
        spans = spans.where(F.assert_true(~F.coalesce(outside, F.lit(False)), F.lit("a height is outside the range")).isNull())
    return spans.withColumns({"code": code, "clipped": outside})


# Fixed values of the height preview: colour stops over the height range, the light's direction (east, south, up), the darkest and
# brightest shade, the shade that leaves a colour as it is, and the colour of water.
STOPS = [(0.0, 90, 143, 92), (0.2, 130, 169, 94), (0.45, 175, 164, 111), (0.7, 165, 140, 123), (1.0, 241, 239, 229)]
LIGHT, SHADES, NEUTRAL, WATER = (-0.4, 0.3, 0.6), (0.25, 1.0), 0.8, (68, 131, 171)


def _within(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ramp(t: Column, stops: list[tuple]) -> Column:
    """Piecewise linear: the first value and what each stretch adds up to t."""
    out = F.lit(float(stops[0][1]))
    for (t0, v0), (t1, v1) in zip(stops, stops[1:]):
        out = out + _within((t - t0) / (t1 - t0), 0.0, 1.0) * (v1 - v0)
    return out


def hillshade_preview(cells: DataFrame, by: list[str], dx: float, dy: float, water_level: float, every: int = 1,
                      biome_colours: dict[int, tuple[int, int, int]] | None = None) -> DataFrame:
    """Shaded colours r, g, b of every ``every``-th row and column, from the slopes between those.

    Ground is lit by a fixed light and coloured by its height in the map's range; ``biome_colours`` colours by the biome column
    instead, where a biome is listed. Water has its own colour, unshaded.
    """
    picked = cells.where((F.col("row") % every == 0) & (F.col("col") % every == 0)).withColumns({"row": F.floor(F.col("row") / every), "col": F.floor(F.col("col") / every)})
    span = picked.groupBy(*by).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    rows = with_gradient(picked, by, dx * every, dy * every).join(span, by)
    height = _within((F.col("z") - F.col("_lo")) / F.greatest(F.lit(1.0), F.col("_hi") - F.col("_lo")), 0.0, 1.0)
    east, south, up = LIGHT
    facing = (F.col("_gx") * east + F.col("_gy") * south + up) / F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2 + 1)
    rows = rows.withColumns({"_t": height, "_shade": _within(facing, *SHADES) / NEUTRAL})
    colours = []
    for i, (name, water) in enumerate(zip("rgb", WATER), 1):
        ground = ramp(F.col("_t"), [(t[0], t[i]) for t in STOPS])
        if biome_colours:
            table = F.create_map(*[F.lit(x) for b, colour in biome_colours.items() for x in (int(b), float(colour[i - 1]))])
            ground = F.coalesce(table[F.col("biome").cast("int")], ground)
        lit = F.floor(_within(ground * F.col("_shade"), 0.0, 255.0))
        colours.append(F.when(F.col("z") < water_level, F.lit(water)).otherwise(lit).cast("int").alias(name))
    return rows.select(*by, "row", "col", *colours)


def datum_conflicts(contributions: DataFrame, by: list[str]) -> DataFrame:
    """Maps whose contributing sources name more than one vertical reference."""
    named = contributions.where("contributed > 0 AND datum <> 'Unknown / unchanged'")
    return named.groupBy(*by).agg(F.countDistinct("datum").alias("datums"), F.array_sort(F.collect_set("datum")).alias("names")).where("datums > 1")


def terrain_quality(contributions: DataFrame, by: list[str], native_x: float, native_y: float, total: int) -> DataFrame:
    """Source spacing behind a map: finest and coarsest real pair, ranges, coarse and unknown sample counts."""
    live = contributions.where("contributed > 0")
    known = F.col("rx").isNotNull() & F.col("ry").isNotNull() & (F.col("rx") > 0) & (F.col("ry") > 0)
    order = F.struct(F.greatest("rx", "ry"), F.col("rx") * F.col("ry"), F.col("rx"), F.col("ry"))
    pair, rank = F.when(known, F.struct("rx", "ry")), F.when(known, order)
    coarse = known & ((F.col("rx") > native_x * (1 + 1e-6)) | (F.col("ry") > native_y * (1 + 1e-6)))
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("contributed"))), F.lit(0))
    out = live.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sources"), F.sum("contributed").alias("samples"), F.min_by(pair, rank).alias("finest"), F.max_by(pair, rank).alias("coarsest"),
        F.min(F.when(known, F.col("rx"))).alias("min_x"), F.max(F.when(known, F.col("rx"))).alias("max_x"),
        F.min(F.when(known, F.col("ry"))).alias("min_y"), F.max(F.when(known, F.col("ry"))).alias("max_y"),
        some(~known).alias("unknown_samples"), some(coarse).alias("coarse_samples"))
    return out.withColumn("coarse_percent", F.col("coarse_samples") * 100.0 / total)


# ---- biomes -----------------------------------------------------------------------------------------------------

CODES = [0, 63, 127, 191, 255]  # fixed grey codes of biomes 0..4


def classify_biomes(cells: DataFrame, by: list[str], options, cover: DataFrame | None = None, paint: DataFrame | None = None) -> DataFrame:
    """Biome per cell: base, highland, rock by height or slope, land cover, water, and paint over all.

    ``cells`` carry z and slope; ``cover`` and ``paint`` carry row, col and biome.
    """
    rule = (F.when((F.col("z") >= options.alpine_m) | (F.col("slope") >= options.rock_slope), options.rock)
            .when(F.col("z") >= options.highland_m, options.highland).otherwise(options.base))
    rows, value = cells, rule
    at = [*by, "row", "col"]
    if cover is not None:
        rows, value = rows.join(cover.select(*at, F.col("biome").alias("_cover")), at, "left"), F.coalesce(F.col("_cover"), rule)
    if options.water:
        value = F.when(F.col("z") < options.water_level, 0).otherwise(value)
    if paint is not None:
        rows, value = rows.join(paint.select(*at, F.col("biome").alias("_paint")), at, "left"), F.coalesce(F.col("_paint"), value)
    return rows.select(*at, value.cast("int").alias("biome"))


def scale_offset(z: Column | str, scale: float, offset: float) -> Column:
    """Heights scaled and moved, as the last step before a target's own range."""
    return (F.col(z) if isinstance(z, str) else z) * scale + offset


def import_biomes(cells: DataFrame, by: list[str] | None = None, shape: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Grey codes to biome ids, and the cells whose code is none. With ``shape`` a grid of other rows and columns is an error."""
    if shape is not None:
        size = cells.groupBy(*(by or [])).agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count(F.lit(1)).alias("n"))
        if not size.where((F.col("r") != shape[0] - 1) | (F.col("c") != shape[1] - 1) | (F.col("n") != shape[0] * shape[1])).isEmpty():
            raise ValueError(f"biome grids have {shape[0]} rows and {shape[1]} columns")
    found = F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("code").cast("int")) - 1
    rows = cells.withColumn("biome", found.cast("int"))
    return rows.where("biome >= 0"), rows.where("biome < 0")


def biome_histogram(cells: DataFrame, by: list[str]) -> DataFrame:
    """Vertices and share of every biome, those without any included."""
    total = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    have = cells.groupBy(*by, "biome").agg(F.count(F.lit(1)).alias("vertices"))
    every = total.withColumn("biome", F.explode(F.sequence(F.lit(0), F.lit(4))))
    n = F.coalesce("vertices", F.lit(0))
    return every.join(have, [*by, "biome"], "left").select(*by, "biome", n.alias("vertices"), (n * 100.0 / F.col("_n")).alias("percent"))


# ---- heights for other features -----------------------------------------------------------------------------------

def reference_heights(points: DataFrame, cells: DataFrame, by: list[str], grid: GridSpec) -> DataFrame:
    """One base height per distinct position (six decimals), given back to every point."""
    key = points.withColumns({"kx": F.round("x", 6), "ky": F.round("y", 6)})
    unique = key.select(*by, "kx", "ky").distinct().withColumns({"x": F.col("kx"), "y": F.col("ky")})
    heights = sample_at_points(cells, unique, by, ["kx", "ky"], grid)
    return key.join(heights, [*by, "kx", "ky"], "left").drop("kx", "ky")


def water_bed_heights(corners: DataFrame, cells: DataFrame, by: list[str], grid: GridSpec, depth: float = 0.5) -> DataFrame:
    return reference_heights(corners, cells, by, grid).withColumn("z", F.col("z") - depth)


def estimate_structure_heights(guides: DataFrame, cells: DataFrame, by: list[str], ids: list[str], grid: GridSpec) -> DataFrame:
    """Bridge and tunnel heights between guide ends; a tunnel sags by depth * sin(pi t)."""
    ends = guides.select(*by, *ids, F.inline(F.array(
        F.struct(F.lit(0).alias("_e"), F.col("gx0").alias("x"), F.col("gy0").alias("y")), F.struct(F.lit(1).alias("_e"), F.col("gx1").alias("x"), F.col("gy1").alias("y")))))
    z = reference_heights(ends, cells, by, grid).groupBy(*by, *ids).agg(F.max(F.when(F.col("_e") == 0, F.col("z"))).alias("_a"), F.max(F.when(F.col("_e") == 1, F.col("z"))).alias("_b"))
    at = lambda t: (F.col("_a") * (1 - F.col(t)) + F.col("_b") * F.col(t)
                    - F.when(F.col("tunnel"), F.col("depth") * F.sin(F.col(t) * math.pi)).otherwise(0.0))
    return guides.join(z, [*by, *ids]).withColumns({"z0": at("t0"), "z1": at("t1")}).drop("_a", "_b")
