"""Schemas of the tables."""

from __future__ import annotations

BOUNDS = "minx double, miny double, maxx double, maxy double"
CENSUS_COUNTS = "shape_id string, value double"
CENSUS = (
    "shape_id string, parent_id string, admin_level int, shape_name string, shape_name_simple string, path_to_top_parent string, "
    f"population_total double, household_total double, geometry binary, {BOUNDS}"
)
WPP = "iso3 string, year_id int, population double"
ESTIMATES = "location_id int, year_id int, population double"
HIERARCHY = "location_id int, location_name string, location_code string, parent_id int, region_id int, level int, most_detailed int"
SUPPLEMENT = "location_id int, location_name string, region_id int, location_code string, category string"
RAKING_POPULATION = f"{HIERARCHY}, year_id int, population double, wpp_population double"
SHAPES = f"location_id int, geometry binary, {BOUNDS}"
MODELING_FRAME = f"tile_key string, block_key string, geometry binary, {BOUNDS}"
VALIDATION_FRAME = "iso3 string, year string, block_key string"
RASTER_TILE = (
    "resolution string, feature string, time_point string, block_key string, chunk_row int, chunk_col int, height int, width int, "
    "transform array<double>, crs string, nodata double, data array<float>"
)
INTERSECTIONS = (
    "admin_id string, admin_population double, admin_area double, block_key string, tile_key string, time_point string, pixel_id int, "
    "pixel_area double, isection_area double, denominator string, pixel_value double"
)
PIXEL_WEIGHTS = "admin_id string, tile_key string, pixel_id int, weight double"
RAKING_FACTORS = "time_point string, block_key string, location_id int, raw_pop double, true_pop double, raking_factor double"
VALIDATION = "shape_id string, iso3 string, year string, population double"
