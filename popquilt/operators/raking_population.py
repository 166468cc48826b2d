"""National and subnational population series reconciled into one table of raking targets.

Tables: ``wpp`` (iso3, year_id, population), ``metadata`` (location_id, location_name,
region_id, location_code), ``supplement`` (the same and category), ``estimates`` (location_id,
year_id, population and the hierarchy's columns). Every step is a lazy DataFrame but for
``nearest_ancestor`` (and what calls it) and ``validate``, which run jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popquilt.functions.constants import NO_REGION
from popquilt.functions.semantics import clip_low, ratio, total
from popquilt.session import checkpointed

WPP, UNMODELED, ZERO = "wpp", "unmodeled", "zero_population"
HIERARCHY = ("location_id", "location_name", "location_code", "parent_id", "region_id", "level", "most_detailed")
#: Series that stand under another country's code.
MERGED = {"HKG": "CHN", "MAC": "CHN", "XKX": "SRB"}


def merge_countries(wpp: DataFrame, merged: dict[str, str] = MERGED) -> DataFrame:
    """Adds up the series that belong to one country; a merged year is missing where all parts are."""
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in merged.items() for x in kv)), F.col("iso3")), F.col("iso3"))
    return wpp.groupBy(code.alias("iso3"), "year_id").agg(F.sum("population").alias("population"))


def add_metadata(wpp: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of the series with countries (level 3 and the supplement of that category) on the code."""
    return wpp.join(metadata, F.col("iso3") == F.col("location_code"), "left").drop("iso3")


def country_metadata(hierarchy: DataFrame, supplement: DataFrame) -> DataFrame:
    columns = ["location_id", "location_name", "region_id", "location_code"]
    return hierarchy.filter("level = 3").select(columns).unionByName(supplement.filter(F.col("category") == WPP).select(columns))


def location_regions(mapping: DataFrame, hierarchy: DataFrame, overrides: DataFrame) -> DataFrame:
    """(location_id, region_id): an override, else the hierarchy's region, else the mapping's own."""
    return (
        mapping.select("location_id", F.col("region_id").alias("_own"))
        .join(hierarchy.select("location_id", F.col("region_id").alias("_tree")), "location_id", "left")
        .join(overrides.select("location_id", F.col("region_id").alias("_over")), "location_id", "left")
        .select("location_id", F.coalesce("_over", "_tree", "_own").alias("region_id"))
    )


def add_absent_locations(wpp: DataFrame, supplement: DataFrame) -> DataFrame:
    """Adds a row a year for unmodeled locations (missing) and for those without people (0)."""
    value = F.when(F.col("category") == ZERO, F.lit(0.0))
    absent = supplement.filter(F.col("category").isin(UNMODELED, ZERO)).withColumn("population", value).drop("category")
    years = wpp.select("year_id").distinct()
    return wpp.unionByName(absent.crossJoin(F.broadcast(years)), allowMissingColumns=True)


def regional_scalar(wpp: DataFrame) -> DataFrame:
    """Adds ``scalar``: the share of the region's population in the year; 0 for 0 people, missing without region."""
    region = Window.partitionBy("region_id", "year_id")
    share = F.when(F.col("region_id").isNotNull(), ratio("population", F.sum("population").over(region)))
    return wpp.withColumn("scalar", F.when(F.col("population") == 0, F.lit(0.0)).otherwise(share))


def prepare_series(primary: DataFrame, drop_children_of: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """The series with children of listed parents dropped and these parents most detailed.

    With ``forecast``, its years replace those of ``primary``, whose other years are kept for its
    locations and take its metadata.
    """
    listed = drop_children_of.select(F.col("location_id").alias("_listed")).distinct()
    kept = primary.join(listed, F.col("parent_id") == F.col("_listed"), "left_anti").join(listed, F.col("location_id") == F.col("_listed"), "left")
    series = kept.withColumn("most_detailed", F.when(F.col("_listed").isNotNull(), 1).otherwise(F.col("most_detailed"))).drop("_listed")
    if forecast is not None:
        meta = forecast.select(*HIERARCHY).distinct()
        older = series.select("location_id", "year_id", "population").join(forecast.select("year_id").distinct(), "year_id", "left_anti")
        columns = ["location_id", "year_id", "population", *HIERARCHY[1:]]
        series = older.join(meta, "location_id").select(columns).unionByName(forecast.select(columns))
    return series.withColumn("region_id", F.coalesce("region_id", F.lit(NO_REGION)).cast("int"))


def residual_population(estimates: DataFrame) -> DataFrame:
    """(region_id, year_id, left): regions' totals less their most detailed locations, not under 0; 0 without region.

    A region is missing a residual in years for which either side is absent.
    """
    region = estimates.filter("location_id = region_id").select("region_id", "year_id", F.col("population").alias("_region"))
    detailed = estimates.filter("most_detailed = 1").groupBy("region_id", "year_id").agg(total("population").alias("_detailed"))
    both = region.join(detailed, ["region_id", "year_id"], "full").filter(F.col("region_id") != NO_REGION)
    nowhere = estimates.select(F.lit(NO_REGION).alias("region_id"), "year_id", F.lit(0.0).alias("left")).distinct()
    return both.select("region_id", "year_id", clip_low(F.col("_region") - F.col("_detailed")).alias("left")).unionByName(nowhere)


def missing_populations(wpp: DataFrame, estimates: DataFrame) -> DataFrame:
    """Locations of ``wpp`` (with scalar) that ``estimates`` lacks, with their part of the region's residual.

    A region without any residual in a year stops the job, for its people would be lost.
    """
    subset = wpp.join(estimates.select("location_id").distinct(), "location_id", "left_anti").join(estimates.select("year_id").distinct(), "year_id", "left_semi")
    among = Window.partitionBy("region_id", "year_id")
    part = F.when(F.col("scalar") == 0, F.lit(0.0)).otherwise(ratio("scalar", F.sum("scalar").over(among)))
    residual = residual_population(estimates).withColumn("_known", F.lit(True))
    lost = F.raise_error(F.concat(F.lit("no residual population of region "), F.col("region_id"), F.lit(" in "), F.col("year_id"))).cast("double")
    return (
        subset.withColumn("_part", part)
        .join(residual, ["region_id", "year_id"], "left")
        .withColumn("population", F.when(F.col("_known").isNull() & F.col("region_id").isNotNull(), lost).otherwise(F.col("left") * F.col("_part")))
        .withColumns({"most_detailed": F.lit(1), "level": F.lit(3), "parent_id": F.col("region_id")})
        .drop("left", "_part", "scalar", "_known")
    )


def nearest_ancestor(locations: DataFrame, parents: DataFrame, goals: DataFrame) -> DataFrame:
    """(location_id, ancestor_id): the nearest location at or above that is among the goals.

    ``parents`` has (location_id, parent_id). Every location points at itself if it is a goal
    and else at its parent; pointers are followed to where they point, so that each join
    doubles the levels that are climbed. The climb is over when every pointer is at a goal or
    beyond the last parent, or when as many levels are climbed as there are locations, after
    which only circles go on. Each doubling is a job over distinct locations. Locations without such an ancestor get NULL, and so do
    those whose climb goes round in a circle.
    """
    goal = goals.select(F.col("location_id").alias("_goal")).distinct()
    parent = parents.filter("parent_id is not null").groupBy(F.col("location_id").alias("_at")).agg(F.min("parent_id").alias("_parent"))
    ids = [locations.select(F.col("location_id").alias("_at")), parent.select("_at"), parent.select(F.col("_parent").alias("_at"))]
    known = ids[0].union(ids[1]).union(ids[2]).distinct()
    known = known.join(goal, F.col("_at") == F.col("_goal"), "left").join(parent, "_at", "left")
    known = checkpointed(known.select("_at", F.coalesce("_goal", "_parent").alias("_to"), (F.col("_goal").isNull() & F.col("_parent").isNotNull()).alias("_open")))
    climbed = 1
    while True:
        going, n = known.agg(F.count_if("_open"), F.count("_at")).first()
        if not going or climbed >= n:
            break
        further = known.select(F.col("_at").alias("_to"), F.col("_to").alias("_beyond"), F.col("_open").alias("_more"))
        moved = known.filter("_open").join(further, "_to", "left").select("_at", F.col("_beyond").alias("_to"), F.col("_more").alias("_open"))
        known = checkpointed(known.filter("not _open").unionByName(moved))
        climbed *= 2
    found = known.filter("not _open").join(goal, F.col("_to") == F.col("_goal")).select(F.col("_at").alias("location_id"), F.col("_goal").alias("ancestor_id"))
    return locations.select("location_id").distinct().join(found, "location_id", "left").select("location_id", "ancestor_id")


def raking_population(estimates: DataFrame, wpp: DataFrame, missing: DataFrame) -> DataFrame:
    """Most detailed and missing locations with ``wpp_population``.

    Where a location has no series of its own, its ancestor's is scaled by the location's
    share of the ancestor in ``estimates``.
    """
    own = wpp.select("location_id", "year_id", F.col("population").alias("wpp_population"))
    full = estimates.filter("most_detailed = 1").unionByName(missing, allowMissingColumns=True).join(own, ["location_id", "year_id"], "left")
    climb = nearest_ancestor(full, estimates.select("location_id", "parent_id"), wpp).withColumnRenamed("ancestor_id", "_up")
    above = own.select(F.col("location_id").alias("_up"), "year_id", F.col("wpp_population").alias("_wpp_up"))
    estimates_above = estimates.select(F.col("location_id").alias("_up"), "year_id", F.col("population").alias("_estimates_up"))
    filled = full.join(climb, "location_id", "left").join(above, ["_up", "year_id"], "left").join(estimates_above, ["_up", "year_id"], "left")
    scaled = F.col("_wpp_up") * ratio("population", "_estimates_up")
    return filled.withColumn("wpp_population", F.coalesce("wpp_population", F.when(F.col("population").isNotNull(), scaled))).drop("_up", "_wpp_up", "_estimates_up")


def raking_shapes(primary: DataFrame, fallback: DataFrame, overridden: list[int], needed: DataFrame) -> DataFrame:
    """Shapes of the needed locations: the primary ones but for those overridden, else the fallback."""
    wanted = needed.select("location_id").distinct()
    first = primary.filter(~F.col("location_id").isin(overridden)).join(wanted, "location_id", "left_semi")
    return first.unionByName(fallback.join(wanted, "location_id", "left_semi").join(first.select("location_id"), "location_id", "left_anti"))


def unmatched(population: DataFrame, shapes: DataFrame) -> DataFrame:
    """(location_id, missing): locations without a shape, and shapes without population."""
    p, s = population.select("location_id").distinct(), shapes.select("location_id").distinct()
    return p.join(s, "location_id", "left_anti").withColumn("missing", F.lit("shape")).unionByName(
        s.join(p, "location_id", "left_anti").withColumn("missing", F.lit("population"))
    )


def validate(population: DataFrame, shapes: DataFrame) -> None:
    if found := unmatched(population, shapes).limit(10).collect():
        raise ValueError("population and shapes differ: " + ", ".join(f"{r['location_id']} has no {r['missing']}" for r in found))


def build(wpp: DataFrame, primary: DataFrame, hierarchy: DataFrame, supplement: DataFrame, drop_children_of: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """The whole chain, lazily."""
    series = add_absent_locations(add_metadata(merge_countries(wpp), country_metadata(hierarchy, supplement)), supplement)
    estimates = prepare_series(primary, drop_children_of, forecast)
    return raking_population(estimates, series, missing_populations(regional_scalar(series), estimates))
