"""Fixed values of the data model: versions, time points, radii and reference systems."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

RESOLUTIONS = ("40", "100")
RADII = (100, 500, 1000, 2500, 5000, 10000)
NOISE, AVERAGE_NOISE, LEAST_HEIGHT, LEAST_DENSITY, NO_REGION = 0.01, 0.005, 2.4384, 0.01, -1
NIGHT_LIGHT_YEARS = (2000, 2022)


#: Names of the measures that are derived from a version's bands.
DERIVED = ("density", "residential_density", "nonresidential_density", "volume", "residential_volume", "nonresidential_volume")
#: provider_version, first and last time point, quarters from one to the next, and whether it has building heights.
BUILT_TABLE = (
    ("ghsl_r2023a", "1975q1", "2025q1", 20, True),
    ("microsoft_v6", "2020q2", "2023q4", 1, False),
    ("microsoft_v7", "2020q2", "2023q4", 1, True),
    ("microsoft_v7_1", "2020q2", "2024q2", 1, True),
)
#: The measures that population may be spread by.
SPREAD_BY = ("density", "volume", "residential_density", "residential_volume")


def quarters(first: str, last: str, step: int = 1) -> tuple[str, ...]:
    """Time points from one to another, every ``step`` quarters."""
    a, b = (int(t[:4]) * 4 + int(t[5]) - 1 for t in (first, last))
    return tuple(f"{k // 4}q{k % 4 + 1}" for k in range(a, b + 1, step))


@dataclass(frozen=True)
class Built:
    """A built version as a row of BUILT_TABLE says."""

    name: str
    time_points: tuple[str, ...]
    has_height: bool


BUILT_VERSIONS = {name: Built(name, quarters(first, last, step), height) for name, first, last, step, height in BUILT_TABLE}
DENOMINATORS = tuple("_".join(pair) for pair in product(BUILT_VERSIONS, SPREAD_BY))
#: Every version's time points, and the first quarter of each year that the longest of them covers.
ALL_TIME_POINTS = tuple(sorted(set(quarters("1975q1", "2025q1", 4)).union(*(v.time_points for v in BUILT_VERSIONS.values()))))


@dataclass(frozen=True)
class Crs:
    """A reference system: projection, central meridian and bounds (xmin, ymin, xmax, ymax)."""

    name: str
    projection: str
    meridian: float
    bounds: tuple[float, float, float, float]
    proj: str
    code: str | None = None

    def __post_init__(self):
        x0, y0, x1, y1 = self.bounds
        if not (x0 < x1 and y0 < y1):
            raise ValueError(f"{self.name}: bounds are empty")
        if not self.proj.startswith("+proj="):
            raise ValueError(f"{self.name}: not a PROJ string")


#: Projection, central meridian, bounds, PROJ string and code of each reference system.
CRS = {
    "wgs84": Crs("wgs84", "longlat", 0, (-180.0, -90.0, 180.0, 90.0), "+proj=longlat +datum=WGS84 +no_defs +type=crs", "EPSG:4326"),
    "wgs84_anti_meridian": Crs("wgs84_am", "longlat", 180, (-180.0, -90.0, 180.0, 90.0), "+proj=longlat +lon_0=180 +datum=WGS84 +no_defs +type=crs"),
    "itu_anti_meridian": Crs("itu_am", "merc", 150, (-5711803.07, -8362698.55, 15807367.69, 10023392.49), "+proj=merc +lon_0=150 +k=1 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs +type=crs", "EPSG:3832"),
    "mollweide": Crs("mollweide", "moll", 0, (-18040095.7, -9020047.85, 18040095.7, 9020047.85), "+proj=moll +lon_0=0 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs +type=crs", "ESRI:54009"),
    "mollweide_anti_meridian": Crs("mollweide_am", "moll", 180, (-18040095.7, -9020047.85, 18040095.7, 9020047.85), "+proj=moll +lon_0=180 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs +type=crs"),
    "world_cylindrical": Crs("world_cylindrical", "cea", 0, (-20037508.34, -6363885.33, 20037508.34, 6363885.33), "+proj=cea +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs +type=crs", "ESRI:54034"),
    "world_cylindrical_anti_meridian": Crs("world_cylindrical_am", "cea", 180, (-20037508.34, -6363885.33, 20037508.34, 6363885.33), "+proj=cea +lat_ts=0 +lon_0=180 +x_0=0 +y_0=0 +datum=WGS84 +units=m +no_defs +type=crs"),
    "web_mercator": Crs("web_mercator", "webmerc", 0, (-20037508.34, -20048966.1, 20037508.34, 20048966.1), "+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +nadgrids=@null +wktext +no_defs +type=crs", "EPSG:3857"),
}
CRS |= {"equal_area": CRS["world_cylindrical"], "equal_area_anti_meridian": CRS["world_cylindrical_anti_meridian"]}

#: Output grids of the resampling step: (reference system, cell size, statistic).
UPSAMPLE = {
    **{f"world_cylindrical_{m}f": ("world_cylindrical", float(m), "average") for m in (250, 500, 1000, 2000, 4000, 8000, 10000, 16000)},
    **{f"world_cylindrical_{m}": ("world_cylindrical", float(m), "sum") for m in (1000, 5000, 10000)},
    "wgs84_0p1": ("wgs84", 0.1, "sum"),
    "wgs84_0p01": ("wgs84", 0.01, "sum"),
}
