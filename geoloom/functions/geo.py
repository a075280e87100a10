"""Projection, box and distance expressions. Every function returns Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from geoloom.spec import Bounds, MapSpec

EARTH = 6378137.0        # projection radius, metres
MEAN_EARTH = 6371008.8   # haversine radius, metres
WORLD = 2 * math.pi * EARTH


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def stretched_lat(lat) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2))


def _stretch(lat: float) -> float:
    return math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def project_xy(lat, lon, spec: MapSpec) -> tuple[Column, Column]:
    b = spec.bounds
    low, high = _stretch(b.south), _stretch(b.north)
    x = ((col(lon) - b.west) / (b.east - b.west) - 0.5) * spec.width
    y = ((stretched_lat(lat) - low) / (high - low) - 0.5) * spec.height
    return x, y


def unproject_xy(x, y, spec: MapSpec) -> tuple[Column, Column]:
    west, south, east, north = (float(v) for v in _metres(spec.bounds))
    mx = F.lit(west) + (col(x) / spec.width + 0.5) * (east - west)
    my = F.lit(south) + (col(y) / spec.height + 0.5) * (north - south)
    return F.degrees(2 * F.atan(F.exp(my / EARTH)) - math.pi / 2), F.degrees(mx / EARTH)


def _metres(b: Bounds) -> tuple[float, float, float, float]:
    return (EARTH * math.radians(b.west), EARTH * _stretch(b.south),
            EARTH * math.radians(b.east), EARTH * _stretch(b.north))


def mercator_xy(lat, lon) -> tuple[Column, Column]:
    return F.radians(col(lon)) * EARTH, stretched_lat(lat) * EARTH


def mercator_latlon(x, y) -> tuple[Column, Column]:
    return F.degrees(F.atan(F.sinh(col(y) / EARTH))), F.degrees(col(x) / EARTH)


def mercator_bounds(south, west, north, east) -> tuple[Column, Column, Column, Column]:
    x0, y0 = mercator_xy(south, west)
    x1, y1 = mercator_xy(north, east)
    return x0, y0, x1, y1


def ground_extent(south, west, north, east) -> tuple[Column, Column]:
    x0, y0, x1, y1 = mercator_bounds(south, west, north, east)
    scale = F.cos(F.radians((col(south) + col(north)) / 2))
    return (x1 - x0) * scale, (y1 - y0) * scale


def area_bounds(lat, lon, width: float, height: float, coverage: float = 1.0):
    """Box of a map of given ground size around a centre."""
    if not 0.01 <= coverage <= 100:
        raise ValueError("coverage is 0.01..100")
    x, y = mercator_xy(lat, lon)
    scale = F.lit(coverage) / F.cos(F.radians(col(lat)))
    south, west = mercator_latlon(x - scale * width / 2, y - scale * height / 2)
    north, east = mercator_latlon(x + scale * width / 2, y + scale * height / 2)
    return south, west, north, east


def tile_pixel(lat, lon, zoom) -> tuple[Column, Column]:
    x, y = mercator_xy(lat, lon)
    n = F.pow(F.lit(2.0), col(zoom)) * 256
    return (x / WORLD + 0.5) * n, (F.lit(0.5) - y / WORLD) * n


def pixel_latlon(px, py, zoom) -> tuple[Column, Column]:
    n = F.pow(F.lit(2.0), col(zoom)) * 256
    across = lambda share: share * 2 * math.pi * EARTH  # noqa: E731  factor by factor: a rounded product would move values that lie on half a unit
    return mercator_latlon(across(col(px) / n - 0.5), across(F.lit(0.5) - col(py) / n))


def haversine_m(lat0, lon0, lat1, lon1) -> Column:
    a, b, c, d = col(lat0), col(lon0), col(lat1), col(lon1)
    h = (F.pow(F.sin(F.radians(c - a) / 2), 2)
         + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2))
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * MEAN_EARTH)


def cell_resolution_m(x0, y0, dx, dy, nrow, ncol, at_lat, at_lon) -> tuple[Column, Column]:
    """Ground size of the source cell nearest to a place, for a grid on degrees (dy negative)."""
    c = F.least(F.greatest((col(at_lon) - col(x0)) / col(dx), F.lit(0.5)), col(ncol) - 0.5)
    r = F.least(F.greatest((col(at_lat) - col(y0)) / col(dy), F.lit(0.5)), col(nrow) - 0.5)
    lon, lat = col(x0) + c * col(dx), col(y0) + r * col(dy)
    return haversine_m(lat, lon, lat, lon + col(dx)), haversine_m(lat, lon, lat + col(dy), lon)


def finite(value) -> Column:
    value = col(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def valid_position(lat, lon) -> Column:
    return (finite(lat) & finite(lon) & (col(lat) > -85) & (col(lat) < 85)
            & (col(lon) >= -180) & (col(lon) <= 180))


def valid_box(south, west, north, east) -> Column:
    s, w, n, e = col(south), col(west), col(north), col(east)
    return (finite(s) & finite(w) & finite(n) & finite(e) & (s > -85) & (s < n) & (n < 85)
            & (w >= -180) & (w < e) & (e <= 180))


def on_map(x, y, width: float, height: float) -> Column:
    return (F.abs(col(x)) <= width / 2) & (F.abs(col(y)) <= height / 2)


def bbox_intersects(a, b) -> Column:
    """Open rule: boxes (minx, miny, maxx, maxy) that only share an edge do not meet."""
    a, b = [col(v) for v in a], [col(v) for v in b]
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def bbox_touches(a, b) -> Column:
    """Closed rule: a shared edge counts, for tiles that only feed a map corner."""
    a, b = [col(v) for v in a], [col(v) for v in b]
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def expand_box(south, west, north, east, by: float = 0.002):
    """Request box widened so that a map corner keeps its interpolation neighbours."""
    s, w, n, e = col(south), col(west), col(north), col(east)
    dlon = F.lit(by) / F.greatest(F.lit(0.08), F.cos(F.radians((s + n) / 2)))
    return (F.greatest(F.lit(-85 + 1e-8), s - by), F.greatest(F.lit(-180.0), w - dlon),
            F.least(F.lit(85 - 1e-8), n + by), F.least(F.lit(180.0), e + dlon))


def float32(value) -> Column:
    return col(value).cast("float").cast("double")


def inward_edge(value, limit) -> Column:
    """A coordinate on the positive map edge moves in by a centimetre."""
    v, top = col(value), col(limit)
    return F.when((v > top - 0.01) & (v <= top + 0.000001), top - 0.01).otherwise(v)


def mm(value) -> Column:
    """Thousandths, rounded half up: equal in every engine."""
    return F.floor(col(value) * 1000 + 0.5).cast("long")


def dist(x0, y0, x1, y1) -> Column:
    dx, dy = col(x1) - col(x0), col(y1) - col(y0)
    return F.sqrt(dx * dx + dy * dy)


# The sides and vertices that a height grid may have.
LEAST_SIDE, MOST_SIDE, MOST_VERTICES = 33, 16385, 53_000_000


def grid_side(length: Column | str, spacing: float) -> Column:
    """Vertices along a side: one more than the spacings that fit best."""
    return F.round((F.col(length) if isinstance(length, str) else length) / spacing).cast("long") + 1


def valid_grid(nx: str, ny: str) -> Column:
    return F.col(nx).between(LEAST_SIDE, MOST_SIDE) & F.col(ny).between(LEAST_SIDE, MOST_SIDE) & (F.col(nx) * F.col(ny) <= MOST_VERTICES)
