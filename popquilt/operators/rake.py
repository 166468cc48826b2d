"""Raking: pixels scaled so that every location sums to its target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popquilt.functions.semantics import ratio, total


def factors(pixels: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, location_id, raw_pop, true_pop, raking_factor) from pixels (by, location_id, value) and targets (by, location_id, population).

    Partial sums are taken before the shuffle. A location of either side only is kept; where
    the raw sum is 0 or missing the factor is missing.
    """
    keys = [*by, "location_id"]
    raw = pixels.filter("location_id is not null").groupBy(*keys).agg(total("value").alias("raw_pop"))
    true = targets.select(*keys, F.col("population").alias("true_pop"))
    return raw.join(true, keys, "full").withColumn("raking_factor", ratio("true_pop", "raw_pop"))


def by_block(factor: DataFrame, blocks: DataFrame) -> DataFrame:
    """Factors for each (block_key, location_id) in which a location lies."""
    return blocks.select("block_key", "location_id").distinct().join(factor, "location_id")


def rake(pixels: DataFrame, factor: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels with ``raked``: value times the location's factor, missing outside any location."""
    keys = [*by, "location_id"]
    return pixels.join(factor.select(*keys, "raking_factor"), keys, "left").withColumn("raked", F.col("value") * F.col("raking_factor")).drop("raking_factor")


def rake_fine(prediction: DataFrame, mask: DataFrame, targets: DataFrame) -> DataFrame:
    """Raking on a finer mask: (row, col, location_id, raked) of mask cells.

    ``prediction`` has (row, col, value) on the mask's grid, ``mask`` (row, col, inside,
    location_id); the cells inside without location take the nearest one's first (see
    ``raster.fill_nearest``).
    """
    cells = mask.filter("location_id is not null").select("row", "col", "location_id").join(prediction, ["row", "col"], "left")
    return rake(cells, factors(cells, targets)).select("row", "col", "location_id", "raked")
