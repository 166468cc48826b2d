"""Parsing and formatting of time points, block, group and version keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = 10  # blocks along a side of a mosaic group


def year_of(t: Column) -> Column:
    return F.split(t, "q")[0].cast("int")


def quarter_of(t: Column) -> Column:
    return F.split(t, "q")[1].cast("int")


def time_value(t: Column) -> Column:
    """``2020q3`` as 2020.5."""
    return year_of(t) + (quarter_of(t) - 1) / 4


def time_point(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("q"), quarter.cast("string"))


def _pad(x: Column) -> Column:
    return F.lpad(x.cast("string"), 4, "0")


def block_key(x: Column, y: Column) -> Column:
    return F.concat(F.lit("B-"), _pad(x), F.lit("X-"), _pad(y), F.lit("Y"))


def block_x(key: Column) -> Column:
    return F.regexp_extract(key, r"-(\d+)X", 1).cast("int")


def block_y(key: Column) -> Column:
    return F.regexp_extract(key, r"X-(\d+)Y", 1).cast("int")


def group_key(key: Column) -> Column:
    """The mosaic group of a block. Every block has one, those of the last row and column too."""
    x, y = (F.floor(b(key) / GROUP).cast("int") for b in (block_x, block_y))
    return F.concat(F.lit("G-"), _pad(x), F.lit("X-"), _pad(y), F.lit("Y"))


def iso3_of(name: Column) -> Column:
    """Of ``{iso3}_{year}``, where the first part may hold ``_`` itself."""
    return F.regexp_extract(name, r"^(.*)_([^_]+)$", 1)


def census_year_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)_([^_]+)$", 2)


def version_number(version: Column) -> Column:
    """Of ``2025_06_21.003``."""
    return F.substring_index(version, ".", -1).cast("int")
