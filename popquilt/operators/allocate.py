"""Dasymetric allocation of administrative counts to pixels.

A row is the intersection of an administrative unit with a pixel of a tile, for one
denominator: (admin_id, admin_population, admin_area, tile_key, pixel_id, pixel_area,
isection_area, denominator, pixel_value). Long form, so that any number of denominators are
one plan: a shuffle by unit and denominator and one by pixel and denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popquilt.functions.semantics import first_by, ratio, safe_divide

UNDEFINED = -1.0


def allocate(intersections: DataFrame, least_built: float | None = None) -> DataFrame:
    """Adds weights, built area, allocated population and occupancy rates.

    Where people live without anything built the rates are -1. ``least_built`` sets built
    area to 0 for units with less of it than that share of a pixel; it is off by default.
    """
    unit, pixel = Window.partitionBy("admin_id", "denominator"), Window.partitionBy("tile_key", "pixel_id", "denominator")
    c = F.col
    rows = intersections.withColumns(
        {
            "admin_population_density": ratio("admin_population", "admin_area"),
            "admin_area_weight": ratio("isection_area", "admin_area"),
            "pixel_area_weight": ratio("isection_area", "pixel_area"),
            "isection_built": c("pixel_value") * c("isection_area"),
            "pixel_built": c("pixel_value") * c("pixel_area"),
        }
    )
    rows = rows.withColumns(
        {
            "admin_multi_tile": F.min("tile_key").over(unit) != F.max("tile_key").over(unit),
            "admin_built": F.coalesce(F.sum("isection_built").over(unit), F.lit(0.0)),
        }
    )
    if least_built is not None:
        low = c("admin_built") < least_built * c("pixel_area")
        rows = rows.withColumns({b: F.when(low, F.lit(0.0)).otherwise(c(b)) for b in ("isection_built", "admin_built")})
    rows = rows.withColumn("isection_population", c("admin_population") * safe_divide("isection_built", "admin_built"))
    rows = rows.withColumn("pixel_population", F.coalesce(F.sum("isection_population").over(pixel), F.lit(0.0)))
    bad = (c("admin_population") > 0) & (c("admin_built") == 0)

    def rate(people: str, built: str) -> Column:
        return F.when(bad, F.lit(UNDEFINED)).otherwise(safe_divide(people, built))

    def logged(x: Column) -> Column:
        return F.when(bad, F.lit(UNDEFINED)).otherwise(F.log1p(x))

    admin, own = rate("admin_population", "admin_built"), rate("pixel_population", "pixel_built")
    return rows.withColumns(
        {
            "admin_occupancy_rate": admin,
            "admin_log_occupancy_rate": logged(admin),
            "pixel_occupancy_rate": own,
            "pixel_log_occupancy_rate": logged(own),
        }
    )


def admin_features(intersections: DataFrame, features: DataFrame) -> DataFrame:
    """(admin_id, feature, value): area-weighted features of units; features (tile_key, pixel_id, feature, value)."""
    weighted = intersections.select("admin_id", "tile_key", "pixel_id", ratio("isection_area", "admin_area").alias("_w"))
    return (
        weighted.join(features, ["tile_key", "pixel_id"])
        .groupBy("admin_id", "feature")
        .agg(F.sum(F.col("value") * F.col("_w")).alias("value"))
    )


def one_per_admin(allocated: DataFrame, order: str = "pixel_id") -> DataFrame:
    """The admin columns, one row a unit and denominator: each column's first value that is not missing."""
    columns = [x for x in allocated.columns if x.startswith("admin") and x != "admin_id"]
    return allocated.groupBy("admin_id", "denominator").agg(*(first_by(x, F.struct("tile_key", order)).alias(x) for x in columns))


def with_geometry(units: DataFrame, shapes: DataFrame, key: str = "admin_id") -> DataFrame:
    """Units with the geometry of the shape that has their key, added again after an aggregation; one without a shape keeps NULL."""
    return units.join(shapes.select(key, "geometry"), key, "left")


def pixel_weights(allocated: DataFrame) -> DataFrame:
    """(admin_id, tile_key, pixel_id, weight), one row a pair."""
    return allocated.groupBy("admin_id", "tile_key", "pixel_id").agg(F.min("admin_area_weight").alias("weight"))


def densify(pixels: DataFrame, tiles: DataFrame, value: str, order: str = "admin_id") -> DataFrame:
    """(tile_key, pixel_id, value) for every pixel of tiles (tile_key, n_pixels); 0 where nothing lies."""
    grid = tiles.select("tile_key", F.explode(F.sequence(F.lit(0), F.col("n_pixels") - 1)).alias("pixel_id"))
    some = pixels.groupBy("tile_key", "pixel_id").agg(first_by(value, F.col(order)).alias(value))
    return grid.join(some, ["tile_key", "pixel_id"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def training_units(units: DataFrame, tiles: DataFrame) -> DataFrame:
    """Units of the tiles with a positive rate that lie in one tile."""
    return units.join(tiles.select("tile_key").distinct(), "tile_key", "left_semi").filter("admin_occupancy_rate > 0 and not admin_multi_tile")


def training_pixels(allocated: DataFrame, least: float = 1e-3) -> DataFrame:
    return allocated.filter((F.col("pixel_occupancy_rate") > least) & ~F.col("admin_multi_tile"))


def coverage(rows: DataFrame, least_built: float = 16.0) -> DataFrame:
    """(label, units, units_percent, population, population_percent) under six masks, one row a unit counted."""
    unit = (
        rows.groupBy("admin_id")
        .agg(
            F.max("admin_population").alias("p"),
            F.max("admin_built").alias("b"),
            (F.min("tile_key") != F.max("tile_key")).alias("multi"),
        )
    )
    people, built, multi = F.coalesce(F.col("p") > 0, F.lit(False)), F.coalesce(F.col("b") > least_built, F.lit(False)), F.col("multi")
    masks = {
        "total": F.lit(True), "multi_tile": multi, "populated": people, "built": built,
        "multi_tile_populated": multi & people, "multi_tile_built": multi & built,
    }
    sums = unit.agg(
        *(F.count(F.when(m, 1)).alias(f"n_{k}") for k, m in masks.items()),
        *(F.coalesce(F.sum(F.when(m, F.col("p"))), F.lit(0.0)).alias(f"p_{k}") for k, m in masks.items()),
    )
    lines = [
        F.struct(
            F.lit(k).alias("label"), F.col(f"n_{k}").alias("units"), (100 * ratio(f"n_{k}", "n_total")).alias("units_percent"),
            F.col(f"p_{k}").alias("population"), (100 * ratio(f"p_{k}", "p_total")).alias("population_percent"),
        )
        for k in masks
    ]
    return sums.select(F.explode(F.array(*lines)).alias("l")).select("l.*")
