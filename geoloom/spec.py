"""Map, grid and option records, checked on the driver before any job starts."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bounds:
    south: float
    west: float
    north: float
    east: float

    def check(self) -> "Bounds":
        values = (self.south, self.west, self.north, self.east)
        if not all(math.isfinite(v) for v in values):
            raise ValueError("bounds must be finite")
        if not (-85 < self.south < self.north < 85 and -180 <= self.west < self.east <= 180):
            raise ValueError("bounds must increase and stay inside the projection")
        return self


@dataclass(frozen=True)
class MapSpec:
    """A geographic box laid on a flat map, origin at the centre, +y north, sizes in metres."""

    bounds: Bounds
    width: float
    height: float

    def __post_init__(self):
        self.bounds.check()
        if not all(math.isfinite(v) and v > 0 for v in (self.width, self.height)):
            raise ValueError("map size must be positive")


@dataclass(frozen=True)
class GridSpec:
    """Vertices on the exact map corners; row 0 is north."""

    width: float
    height: float
    nx: int
    ny: int

    @property
    def dx(self) -> float:
        return self.width / (self.nx - 1)

    @property
    def dy(self) -> float:
        return self.height / (self.ny - 1)


# The sides and the size that an importer of 16-bit height maps takes.
IMPORT_LIMITS = (33, 16385, 53_000_000)


def grid_spec(width: float, height: float, spacing: float | None = 4.0, nx: int | None = None, ny: int | None = None,
              limits: tuple[int, int, int] | None = None) -> GridSpec:
    """A grid from a spacing or from its sides. ``limits`` (least side, largest side, most vertices) are checked only if given."""
    if spacing is not None and nx is None:
        nx, ny = round(width / spacing) + 1, round(height / spacing) + 1
    if min(nx, ny) < 2:
        raise ValueError("a grid has at least two vertices a side")
    if limits and (min(nx, ny) < limits[0] or max(nx, ny) > limits[1] or nx * ny > limits[2]):
        raise ValueError(f"grid sides must be {limits[0]}..{limits[1]} with at most {limits[2]} vertices")
    return GridSpec(float(width), float(height), int(nx), int(ny))


FEATURES = (
    "roads", "railways", "footpaths", "disused_tracks", "bridges", "tunnels", "forests", "shrubs",
    "tree_nodes", "surfaces", "waterways", "fountains", "bollards", "advertising_columns", "place_markers",
)


@dataclass(frozen=True)
class NetworkOptions:
    features: dict = field(default_factory=lambda: {name: True for name in FEATURES})
    road_piece: float = 80.0
    rail_piece: float = 120.0
    tunnel_depth: float = 8.0
    fast_rail: float = 160.0
    road_style: str = "Automatic"
    rail_profile: str = "Automatic"
    electrification: str = "Automatic"

    def on(self, name: str) -> bool:
        return bool(self.features.get(name, True))


@dataclass(frozen=True)
class SceneryOptions:
    features: dict = field(default_factory=lambda: {name: True for name in FEATURES})
    forest_step: float = 18.0
    shrub_step: float = 14.4
    jitter: float = 0.3
    max_trees: int | None = None  # a cap on scattered vegetation, if one is wanted
    seed: str = ""
    broadleaf: tuple = ("Oak", "Linden", "Maple")
    conifer: tuple = ("Fir", "Pine")
    shrubs: tuple = ("Hazel", "Azalea")
    waterway_width: float = 2.0
    face_budget: int | None = None  # a budget of water faces, if one is wanted
    corridor_margin: float = 20.0

    def __post_init__(self):
        if not 0 <= self.jitter <= 0.49 or self.forest_step < 2 or self.shrub_step < 2:
            raise ValueError("steps are at least 2 m and jitter at most 0.49")
        if self.max_trees is not None and self.max_trees < 0:
            raise ValueError("a vegetation cap is not negative")


@dataclass(frozen=True)
class BiomeOptions:
    base: int = 2
    highland: int = 3
    rock: int = 4
    highland_m: float = 500.0
    alpine_m: float = 1500.0
    rock_slope: float = 35.0
    water_level: float = 0.0
    water: bool = True
    cover: dict = field(default_factory=lambda: {
        "forest": 1, "shrubs": 3, "grass": 2, "wetland": 1, "sand": 3, "rock": 4})

    def __post_init__(self):
        if self.alpine_m < self.highland_m:
            raise ValueError("the alpine height is at least the highland height")
