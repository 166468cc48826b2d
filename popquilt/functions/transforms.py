"""Targets from a model's output ``z``, built density ``b`` and pixel area ``a``.

A transform says what the output is; it gives the five targets. For areas larger than a
pixel the pixel targets are summed with area weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popquilt.functions.semantics import natural_log, ratio

TARGETS = ("occupancy_rate", "log_occupancy_rate", "population", "population_density", "log_population_density")
PIXEL_AREA = 1600.0


def _from_occupancy(z: Column, b: Column, a: Column) -> dict[str, Column]:
    return dict(zip(TARGETS, (z, natural_log(z), z * b * a, z * b, natural_log(z) + natural_log(b))))


def _from_population(z: Column, b: Column, a: Column) -> dict[str, Column]:
    logs = natural_log(z) - natural_log(b) - F.ln(a)
    return dict(zip(TARGETS, (ratio(z, b * a), logs, z, z / a, natural_log(z) - F.ln(a))))


def _from_density(z: Column, b: Column, a: Column) -> dict[str, Column]:
    return dict(zip(TARGETS, (ratio(z, b), natural_log(z) - natural_log(b), z * a, z, natural_log(z))))


TRANSFORMS = {
    "occupancy_rate": _from_occupancy,
    "log_occupancy_rate": lambda z, b, a: _from_occupancy(F.exp(z), b, a),
    "population": _from_population,
    "population_density": _from_density,
    "log_population_density": lambda z, b, a: _from_density(F.exp(z), b, a),
}


def targets(kind: str, z: Column, b: Column, area: float | Column = PIXEL_AREA) -> dict[str, Column]:
    """The five targets' expressions; raises ValueError for an unknown kind."""
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown target {kind!r}; known are {sorted(TRANSFORMS)}")
    return TRANSFORMS[kind](z, b, area if isinstance(area, Column) else F.lit(float(area)))


def to_areas(pixels: DataFrame, weights: DataFrame, area: float = PIXEL_AREA) -> DataFrame:
    """Pixel targets summed to areas: weights (admin_id, tile_key, pixel_id, weight), pixels (tile_key, pixel_id, occupancy_rate, population)."""
    summed = (
        pixels.join(weights, ["tile_key", "pixel_id"])
        .groupBy("admin_id")
        .agg(*(F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("occupancy_rate", "population")))
    )
    density = F.col("population") / area
    return summed.select(
        "admin_id", "occupancy_rate", natural_log("occupancy_rate").alias("log_occupancy_rate"),
        "population", density.alias("population_density"), natural_log(density).alias("log_population_density"),
    )
