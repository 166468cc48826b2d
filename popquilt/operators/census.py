"""Census tables: joining counts to shapes, choosing countries and years, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popquilt.functions.semantics import cut, ratio
from popquilt.operators.ranks import percentiles

CENSUS_COLUMNS = ("shape_id", "parent_id", "admin_level", "shape_name", "shape_name_simple", "path_to_top_parent", "population_total", "household_total", "geometry")
INF = float("inf")
#: Edges of the heat map's bins.
POPULATION_EDGES = (-INF, 0, 1, 10, 25, 50, 100, 250, 500, 1000, 5000, INF)
AREA_EDGES = (0, 1e-3, 1e-2, 1e-1, 1, 2, 5, 10, 25, 50, INF)
RUN_ALL = "all"


def align_measures(measures: dict[str, DataFrame]) -> DataFrame:
    """(shape_id, one column a measure) from tables (shape_id, value); a shape may lack a measure."""
    if "population_total" not in measures:
        raise ValueError("population_total is missing")
    tables = [df.select("shape_id", F.col("value").alias(name)) for name, df in measures.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "shape_id", "full")
    return out if "household_total" in measures else out.withColumn("household_total", F.lit(None).cast("double"))


def join_counts(shapes: DataFrame, counts: DataFrame, check: bool = True) -> DataFrame:
    """Shapes with their counts; with ``check``, raises if any shape or count has no partner or several."""
    if check:
        seen = shapes.select("shape_id", F.lit(1).alias("s"), F.lit(0).alias("c")).unionByName(counts.select("shape_id", F.lit(0).alias("s"), F.lit(1).alias("c")))
        wrong = seen.groupBy("shape_id").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).filter("s <> 1 or c <> 1").limit(5).collect()
        if wrong:
            raise ValueError(f"shapes and counts differ: {[(r['shape_id'], r['s'], r['c']) for r in wrong]}")
    return shapes.join(counts, "shape_id")


def census_columns(df: DataFrame) -> DataFrame:
    return df.select(*CENSUS_COLUMNS)


def usable_countries(levels: DataFrame, skip: list[tuple[str, int]] = (), strict: bool = True) -> DataFrame:
    """(iso3, year) with admin levels 0 and 1, and one more where ``strict``, without those to skip; levels (iso3, year, admin_level)."""
    found = levels.groupBy("iso3", "year").agg(F.collect_set("admin_level").alias("l"))
    found = found.filter(F.array_contains("l", 0) & F.array_contains("l", 1) & (F.size("l") > (2 if strict else 1))).select("iso3", "year")
    if not skip:
        return found
    return found.join(levels.sparkSession.createDataFrame(list(skip), found.schema), ["iso3", "year"], "left_anti")


def select_runs(available: DataFrame, iso3: str = RUN_ALL, year: str | int = RUN_ALL) -> DataFrame:
    """The wanted (iso3, year) among those available; raises ValueError if there are none."""
    out = available
    if iso3 != RUN_ALL:
        out = out.filter(F.col("iso3") == iso3.upper())
    if year != RUN_ALL:
        out = out.filter(F.col("year") == year)
    if out.isEmpty():
        raise ValueError(f"nothing for {iso3} {year}")
    return out


def common_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("iso3", "year").intersect(b.select("iso3", "year"))


def under(path: Column, ids: list[str]) -> Column:
    """Whether a comma-separated path of ancestors holds any of the ids; an id is whole, not a part of another."""
    return F.arrays_overlap(F.split(path, ","), F.array(*map(F.lit, ids)))


def country_locations(hierarchy: DataFrame, iso3: str) -> DataFrame:
    """Locations with that code, or if there are none those whose code starts with it."""
    code = F.col("location_code")
    found = hierarchy.filter(code.startswith(iso3))
    exact = found.filter(code == iso3).limit(1).select(F.lit(True).alias("_exact"))
    return found.join(F.broadcast(exact), F.lit(True), "left").filter((code == iso3) | F.col("_exact").isNull()).drop("_exact")  # at most one row


def deepest(units: DataFrame, keys: tuple[str, ...] = ("iso3",)) -> DataFrame:
    """The units of the deepest level of their ``keys`` among those given: a country's, or a census's with (iso3, year)."""
    top = units.groupBy(*keys).agg(F.max("admin_level").alias("admin_level"))
    return units.join(top, [*keys, "admin_level"])


def last_levels(units: DataFrame, count: int = 2) -> DataFrame:
    """The units of their country's ``count`` deepest levels among those given."""
    levels = units.select("iso3", "admin_level").distinct()
    order = Window.partitionBy("iso3").orderBy(F.desc("admin_level"))
    return units.join(levels.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= count).drop("_k"), ["iso3", "admin_level"], "left_semi")


def near_anti_meridian(blocks: DataFrame, margin: int = 8) -> DataFrame:
    """Blocks (block_key, block_x) of the first and last columns."""
    last = blocks.agg(F.max("block_x").alias("_last"))
    return blocks.crossJoin(F.broadcast(last)).filter((F.col("block_x") <= margin) | (F.col("block_x") >= F.col("_last") - margin)).drop("_last")


def summary(units: DataFrame) -> DataFrame:
    """By admin level: number, smallest, largest and mean area, mean population of a unit of the level-0 total."""
    people = units.filter("admin_level = 0").agg(F.max("population_total").alias("_p"))
    by = units.groupBy("admin_level").agg(
        F.count("shape_id").alias("units"), F.min("area").alias("least_area"), F.max("area").alias("largest_area"), F.avg("area").alias("mean_area")
    )
    return by.crossJoin(F.broadcast(people)).withColumn("mean_population", ratio("_p", "units")).drop("_p")


def heatmap(units: DataFrame, x: str = "population_total", y: str = "area", x_edges=POPULATION_EDGES, y_edges=AREA_EDGES) -> DataFrame:
    """(x_bin, y_bin, share) for all bins: share of the units that fall in any."""
    spark: SparkSession = units.sparkSession
    n, m = len(x_edges) - 1, len(y_edges) - 1
    grid = spark.range(n * m).select((F.col("id") / m).cast("int").alias("x_bin"), (F.col("id") % m).cast("int").alias("y_bin"))
    counts = units.select(cut(x, x_edges).alias("x_bin"), cut(y, y_edges).alias("y_bin")).filter("x_bin is not null and y_bin is not null").groupBy("x_bin", "y_bin").count()
    filled = grid.join(F.broadcast(counts), ["x_bin", "y_bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))  # one row a bin
    whole = counts.agg(F.sum("count").alias("_n"))
    return filled.crossJoin(F.broadcast(whole)).select("x_bin", "y_bin", ratio("count", "_n").alias("share"))


def pivoted(shares: DataFrame, bins: int) -> DataFrame:
    """A heat map with a column a y bin, highest x bin first."""
    return shares.groupBy("x_bin").pivot("y_bin", list(range(bins))).agg(F.first("share")).orderBy(F.desc("x_bin"))


def describe(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact percentiles; the latter are found at once (see ``ranks``)."""
    c = F.col(column)
    found = zip(shares, percentiles(df, column, shares))
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
    ).withColumns({f"p{s * 100:g}": F.lit(v).cast("double") for s, v in found})


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count) of even bins; what is outside is left out, and the last bin holds its upper edge."""
    c = F.col(column)
    k = F.least(F.floor((c - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.filter((c >= low) & (c <= high)).groupBy(k.alias("bin")).count()


def pixel_metrics(pixels: DataFrame, units: DataFrame) -> DataFrame:
    """(shape_id, iso3, year, population): labelled pixels (label, value) summed to units (label, shape_id, iso3, year), 0 where none is."""
    sums = pixels.filter("label is not null").groupBy("label").agg(F.sum("value").alias("_v"))
    return units.join(sums, "label", "left").select("shape_id", "iso3", "year", F.coalesce("_v", F.lit(0.0)).alias("population"))
