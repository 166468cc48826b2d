"""Operators along time: interpolation, extrapolation, and the choice of time points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popquilt.functions.constants import ALL_TIME_POINTS, BUILT_VERSIONS, NIGHT_LIGHT_YEARS
from popquilt.functions.keys import quarter_of, time_point, time_value, year_of
from popquilt.functions.semantics import clamp, suppress_noise


def brackets(known: DataFrame, by: list[str]) -> DataFrame:
    """(by, t_from, t_to): neighbouring time points of each key; the last has no t_to."""
    w = Window.partitionBy(*by).orderBy(time_value(F.col("time_point")))
    return known.select(*by, F.col("time_point").alias("t_from"), F.lead("time_point").over(w).alias("t_to"))


def weights(wanted: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """(by, time_point, t_from, t_to, weight): the known points around a wanted one, and the weight of the first.

    A known point, and one beyond the last, stands alone with weight 1; one before the
    first is not given. Within a key the wanted times are few, so that the range test is a
    filter on an equi-join.
    """
    t, a, b = (time_value(F.col(c)) for c in ("time_point", "t_from", "t_to"))
    return (
        wanted.join(brackets(known, by), by)
        .filter((t >= a) & (F.col("t_to").isNull() | (t < b)))
        .withColumn("weight", F.when(F.col("t_to").isNull() | (t == a), F.lit(1.0)).otherwise((b - t) / (b - a)))
    )


def interpolate(values: DataFrame, wanted: DataFrame, by: list[str], keys: list[str], value: str = "value") -> DataFrame:
    """Values at wanted time points: start * weight + end * (1 - weight), noise suppressed.

    ``values`` has (by, keys, time_point, value). ``wanted`` has (by, time_point).
    """
    at = weights(wanted, values.select(*by, "time_point").distinct(), by)
    start = values.withColumnsRenamed({"time_point": "t_from", value: "_start"})
    end = values.withColumnsRenamed({"time_point": "t_to", value: "_end"})
    both = at.join(start, [*by, "t_from"]).join(end, [*by, *keys, "t_to"], "left")
    mixed = F.when(F.col("weight") == 1, F.col("_start")).otherwise(F.col("_start") * F.col("weight") + F.col("_end") * (1 - F.col("weight")))
    return both.select(*by, *keys, "time_point", suppress_noise(mixed).alias(value))


def extrapolated(t: Column, first: Column, last: Column) -> Column:
    """The time point whose slice stands for ``t``: the nearest one within the bounds."""
    return F.when(time_value(t) < time_value(first), first).when(time_value(t) > time_value(last), last).otherwise(t)


def strategies(spark: SparkSession, wanted: DataFrame | None = None) -> DataFrame:
    """(version, time_point, strategy, copy_of): how each version gives each time point, or each of those wanted (a column time_point).

    ``process`` what is in the version, ``interpolate`` what is between two of its points,
    ``skip`` what is beyond; a skipped point is a copy of the first or last slice.
    """
    if wanted is None:
        wanted = spark.createDataFrame([(t,) for t in ALL_TIME_POINTS], "time_point string")
    versions = spark.createDataFrame([(v.name, list(v.time_points), v.time_points[0], v.time_points[-1]) for v in BUILT_VERSIONS.values()], "version string, points array<string>, first string, last string")
    grid = wanted.select("time_point").distinct().crossJoin(F.broadcast(versions))  # a row for each version
    grid = grid.withColumn("known", F.array_contains("points", F.col("time_point")))
    t = time_value(F.col("time_point"))
    outside = (t < time_value(F.col("first"))) | (t > time_value(F.col("last")))
    strategy = F.when(F.col("known"), "process").when(outside, "skip").otherwise("interpolate")
    source = F.when(outside, extrapolated(F.col("time_point"), F.col("first"), F.col("last")))
    return grid.select("version", "time_point", strategy.alias("strategy"), source.alias("copy_of"))


def quarterly(population: DataFrame, wanted: DataFrame, key: str = "location_id", value: str = "population", last_year: int | None = None) -> DataFrame:
    """Population at quarters: the year's and the next year's weighted by the quarter; the last year stands for what follows."""
    if last_year is None:
        years = population.select(F.lit(0).alias("_one"), "year_id").groupBy("_one").agg(F.max("year_id").alias("_last")).drop("_one")
    else:
        years = population.sparkSession.createDataFrame([(last_year,)], "_last int")
    t = F.col("time_point")
    asked = wanted.select("time_point").crossJoin(F.broadcast(years)).select(
        "time_point", F.least(year_of(t), F.col("_last")).alias("_y0"), F.least(year_of(t) + 1, F.col("_last")).alias("_y1"), ((quarter_of(t) - 1) / 4).alias("_w")
    )
    now = population.select(key, F.col("year_id").alias("_y0"), F.col(value).alias("_p0"))
    then = population.select(key, F.col("year_id").alias("_y1"), F.col(value).alias("_p1"))
    return now.join(F.broadcast(asked), "_y0").join(then, [key, "_y1"], "left").select(
        key, "time_point", ((1 - F.col("_w")) * F.col("_p0") + F.when(F.col("_w") > 0, F.col("_w") * F.col("_p1")).otherwise(0.0)).alias(value)
    )


def prediction_time(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """(time_point, source): the point itself if there is a prediction, else the first quarter of the nearest year with any.

    ``available`` is false where the first quarter of that year was not predicted.
    """
    known = available.select(F.col("time_point").alias("source")).distinct()
    span = known.agg(F.min(year_of(F.col("source"))).alias("_lo"), F.max(year_of(F.col("source"))).alias("_hi"))
    asked = wanted.select("time_point").distinct()
    exact = known.select(F.col("source").alias("time_point"), F.lit(True).alias("_exact"))
    near = time_point(clamp(year_of(F.col("time_point")), F.col("_lo"), F.col("_hi")), F.lit(1))
    chosen = asked.join(exact, "time_point", "left").crossJoin(F.broadcast(span)).select(
        "time_point", F.when(F.col("_exact"), F.col("time_point")).otherwise(near).alias("source")
    )
    return chosen.join(known.withColumn("available", F.lit(True)), "source", "left").select("time_point", "source", F.coalesce("available", F.lit(False)).alias("available"))


def extended(selected: DataFrame, first: int = 1950, last: int = 2100) -> DataFrame:
    """The selected time points and the first quarters of all years between the bounds."""
    years = selected.sparkSession.range(first, last + 1).select(F.concat(F.col("id").cast("string"), F.lit("q1")).alias("time_point"))
    return selected.select("time_point").union(years).distinct()


def night_light_year(t: Column) -> Column:
    return clamp(year_of(t), *map(F.lit, NIGHT_LIGHT_YEARS))


def recent(times: DataFrame, prefix: str = "202") -> DataFrame:
    return times.filter(F.col("time_point").startswith(prefix)).orderBy("time_point")
