"""Projections on the WGS84 ellipsoid as column expressions (Snyder, Map Projections, 1987)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

A, INVERSE_FLATTENING = 6378137.0, 298.257223563
E2 = (2 - 1 / INVERSE_FLATTENING) / INVERSE_FLATTENING
E = math.sqrt(E2)


def turn(lon: Column, meridian: float) -> Column:
    """Degrees east of a meridian, from -180 up to 180."""
    return F.when((lon == 180) & F.lit(meridian == 0), F.lit(180.0)).otherwise(F.pmod(lon - meridian + 180, F.lit(360.0)) - 180)


def _authalic(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return (1 - E2) * (s / (1 - E2 * s * s) + F.ln((1 + E * s) / (1 - E * s)) / (2 * E))


def equal_area(lon: Column, lat: Column, meridian: float = 0) -> tuple[Column, Column]:
    """Cylindrical, true at the equator."""
    return A * F.radians(turn(lon, meridian)), A * _authalic(lat) / 2


def mercator(lon: Column, lat: Column, meridian: float = 0) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    y = A * (F.ln((1 + s) / (1 - s)) - E * F.ln((1 + E * s) / (1 - E * s))) / 2
    return A * F.radians(turn(lon, meridian)), y


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    s = F.sin(F.radians(lat))
    return A * F.radians(lon), A * F.ln((1 + s) / (1 - s)) / 2


def mollweide(lon: Column, lat: Column, meridian: float = 0, rounds: int = 8) -> tuple[Column, Column]:
    """On the sphere of radius A; Newton's method for the auxiliary angle."""
    goal = math.pi * F.sin(F.radians(lat))

    def step(t: Column) -> Column:
        slope = 1 + F.cos(t)
        return t - F.when(slope > 1e-9, (t + F.sin(t) - goal) / slope).otherwise(0.0)

    t = repeated(F.radians(lat), step, rounds) / 2
    t = F.when(F.abs(lat) >= 90, F.signum(lat) * math.pi / 2).otherwise(t)
    return A * 2 * math.sqrt(2) / math.pi * F.radians(turn(lon, meridian)) * F.cos(t), A * math.sqrt(2) * F.sin(t)


def repeated(start: Column, step: Callable[[Column], Column], rounds: int) -> Column:
    """``step`` applied that many times; a fold, so that the expression does not grow with the rounds."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start.cast("double"), lambda x, _: step(x))


def project(kind: str, lon: Column, lat: Column, meridian: float = 0) -> tuple[Column, Column]:
    """(x, y) by the projection of a reference system; see ``constants.CRS``."""
    kinds = {
        "longlat": lambda: (turn(lon, meridian), lat),
        "cea": lambda: equal_area(lon, lat, meridian),
        "merc": lambda: mercator(lon, lat, meridian),
        "webmerc": lambda: web_mercator(lon, lat),
        "moll": lambda: mollweide(lon, lat, meridian),
    }
    if kind not in kinds:
        raise ValueError(f"unknown projection {kind!r}")
    return kinds[kind]()


def longitude(x: Column, meridian: float = 0) -> Column:
    """Inverse of ``equal_area`` and ``mercator`` for x."""
    return F.degrees(x / A) + meridian


def latitude(y: Column, rounds: int = 6) -> Column:
    """Inverse of ``equal_area`` for y, by Snyder's iteration."""
    q = 2 * y / A

    def step(phi: Column) -> Column:
        s = F.sin(phi)
        rest = q / (1 - E2) - s / (1 - E2 * s * s) - F.ln((1 + E * s) / (1 - E * s)) / (2 * E)
        return phi + F.when(F.abs(F.cos(phi)) > 1e-9, (1 - E2 * s * s) ** 2 / (2 * F.cos(phi)) * rest).otherwise(0.0)

    return F.degrees(repeated(F.asin(q / 2), step, rounds))
