"""Queries over the benchmark tables, one or more for each operator, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.functions import keys as K
from popquilt.functions import projections as P
from popquilt.functions import semantics as S
from popquilt.functions.constants import ALL_TIME_POINTS, BUILT_VERSIONS
from popquilt.functions.metrics import METRICS
from popquilt.functions.transforms import TARGETS, targets, to_areas
from popquilt.operators import allocate, census, model, rake, raster, spatial_join, timeaxis
from popquilt.operators import geometry as G
from popquilt.operators import raking_population as R
from popquilt.plans import inputs as I
from popquilt.session import shared_folder, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf: f(ship(spark), sf))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# Raking


@query(f"""WITH {I.PIXELS}, {I.TARGETS},
raw AS (SELECT location_id, sum(value) AS raw_pop FROM pixels GROUP BY 1)
SELECT location_id, round(raw_pop, 2) AS raw_pop, round(population, 2) AS true_pop, round(population / raw_pop, 8) AS raking_factor,
  round((SELECT sum(p.value * (t.population / r.raw_pop)) FROM pixels p WHERE p.location_id = r.location_id), 2) AS raked
FROM raw r JOIN targets t USING (location_id)""")
def rake_to_target(spark, sf):
    pixels = I.priced_pixels(spark, sf)
    f = rake.factors(pixels, I.targets(spark, sf))
    raked = rake.rake(pixels, f).groupBy("location_id").agg(F.sum("raked").alias("raked"))
    return f.join(raked, "location_id").select(
        "location_id", F.round("raw_pop", 2).alias("raw_pop"), F.round("true_pop", 2).alias("true_pop"), F.round("raking_factor", 8).alias("raking_factor"), F.round("raked", 2).alias("raked")
    )


@query("""WITH c AS (SELECT c_nationkey + CASE WHEN c_nationkey < 20 THEN 0 ELSE 100 END AS location_id, c_custkey % 10 AS b, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2),
t AS (SELECT s_nationkey + CASE WHEN s_nationkey > 3 THEN 0 ELSE 200 END AS location_id, sum(s_acctbal) AS population FROM supplier GROUP BY 1),
f AS (SELECT location_id, r.raw_pop, t.population AS true_pop FROM (SELECT location_id, sum(v) AS raw_pop FROM c GROUP BY 1) r FULL JOIN t USING (location_id))
SELECT 'B-000' || b || 'X-0000Y' AS block_key, location_id, round(raw_pop, 2) AS raw_pop, round(true_pop, 2) AS true_pop, round(true_pop / nullif(raw_pop, 0), 6) AS raking_factor
FROM (SELECT DISTINCT b, location_id FROM c) JOIN f USING (location_id)""")
def raking_factors_by_block(spark, sf):
    apart = lambda c, near, by: F.col(c) + F.when(near, 0).otherwise(by)
    c = I.table(spark, sf, "customer")
    pixels = c.select(apart("c_nationkey", F.col("c_nationkey") < 20, 100).alias("location_id"), K.block_key(F.col("c_custkey") % 10, F.lit(0)).alias("block_key"), F.col("c_acctbal").alias("value"))
    t = I.table(spark, sf, "supplier").groupBy(apart("s_nationkey", F.col("s_nationkey") > 3, 200).alias("location_id")).agg(F.sum("s_acctbal").alias("population"))
    f = rake.by_block(rake.factors(pixels, t), pixels)
    return f.select("block_key", "location_id", F.round("raw_pop", 2).alias("raw_pop"), F.round("true_pop", 2).alias("true_pop"), F.round("raking_factor", 6).alias("raking_factor"))


# The raking population


@query(f"""WITH {I.SERIES} SELECT location_id, year_id, round(CASE WHEN population = 0 THEN 0 ELSE population / sum(population) OVER (PARTITION BY region_id, year_id) END, 6) AS scalar FROM series""")
def regional_scalar(spark, sf):
    return R.regional_scalar(I.series(spark, sf)).select("location_id", "year_id", F.round("scalar", 6).alias("scalar"))


_MISSING = f"""{I.SERIES}, {I.ESTIMATES},
sc AS (SELECT *, CASE WHEN population = 0 THEN 0 ELSE population / sum(population) OVER (PARTITION BY region_id, year_id) END AS scalar FROM series),
sub AS (SELECT * FROM sc WHERE location_id NOT IN (SELECT location_id FROM estimates)),
det AS (SELECT region_id, year_id, sum(population) AS d FROM estimates WHERE most_detailed = 1 GROUP BY 1, 2),
res AS (SELECT i.region_id, i.year_id, greatest(i.population - det.d, 0) AS left_ FROM estimates i JOIN det USING (region_id, year_id) WHERE i.location_id = i.region_id),
missing AS (SELECT sub.location_id, sub.year_id, left_ * scalar / sum(scalar) OVER (PARTITION BY sub.region_id, sub.year_id) AS population FROM sub JOIN res USING (region_id, year_id))"""


@query(f"WITH {_MISSING} SELECT location_id, year_id, round(population, 3) AS population FROM missing")
def missing_population(spark, sf):
    wpp = R.regional_scalar(I.named(I.series(spark, sf)))
    return R.missing_populations(wpp, I.estimates(spark, sf)).select("location_id", "year_id", F.round("population", 3).alias("population"))


@query(f"""WITH {_MISSING}, wpp AS (SELECT * FROM series WHERE location_id % 3 <> 1 UNION ALL SELECT region_id, region_id, year_id, 2 * sum(population) FROM series GROUP BY region_id, year_id),
full_ AS (SELECT location_id, year_id, population, region_id AS parent_id FROM estimates WHERE most_detailed = 1 UNION ALL SELECT m.location_id, m.year_id, m.population, s.region_id FROM missing m JOIN series s USING (location_id, year_id)),
up AS (SELECT f.*, w.population AS own, u.population AS wu, i.population AS iu FROM full_ f LEFT JOIN wpp w USING (location_id, year_id)
  LEFT JOIN wpp u ON u.location_id = f.parent_id AND u.year_id = f.year_id LEFT JOIN estimates i ON i.location_id = f.parent_id AND i.year_id = f.year_id)
SELECT location_id, year_id, round(population, 3) AS population,
  round(coalesce(own, CASE WHEN location_id % 7 <> 0 THEN wu * population / iu END), 3) AS wpp_population FROM up""")
def raking_population(spark, sf):
    s, i = I.series(spark, sf), I.estimates(spark, sf)
    missing = R.missing_populations(R.regional_scalar(I.named(s)), i)
    high = s.groupBy("region_id", "year_id").agg((2 * F.sum("population")).alias("population")).select(F.col("region_id").alias("location_id"), "region_id", "year_id", "population")
    wpp = s.filter("location_id % 3 <> 1").unionByName(high)
    return rounded(R.raking_population(i, wpp, missing).select("location_id", "year_id", "population", "wpp_population"), 3)


@query("""WITH n AS (SELECT 'L' || n_nationkey AS iso3, n_nationkey, n_regionkey FROM nation),
c AS (SELECT CASE WHEN c_nationkey IN (1, 2) THEN 'L0' WHEN c_nationkey = 24 THEN 'L7' ELSE 'L' || c_nationkey END AS iso3, CAST(c_custkey % 3 AS INT) AS year_id, sum(c_acctbal) AS population FROM customer GROUP BY 1, 2)
SELECT c.year_id, round(c.population, 2) AS population, n.n_nationkey AS location_id FROM c LEFT JOIN (SELECT * FROM n WHERE n_nationkey % 4 <> 3) n ON c.iso3 = n.iso3""")
def merged_countries(spark, sf):
    code = F.concat(F.lit("L"), F.col("c_nationkey").cast("string"))
    wpp = I.table(spark, sf, "customer").groupBy(code.alias("iso3"), (F.col("c_custkey") % 3).cast("int").alias("year_id")).agg(F.sum("c_acctbal").alias("population"))
    meta = I.table(spark, sf, "nation").filter("n_nationkey % 4 <> 3").select(F.col("n_nationkey").alias("location_id"), F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("location_code"))
    merged = R.merge_countries(wpp, {"L1": "L0", "L2": "L0", "L24": "L7"})
    return R.add_metadata(merged, meta).select("year_id", F.round("population", 2).alias("population"), "location_id")


@query(f"""WITH {I.SERIES} SELECT location_id, year_id, round(population, 2) AS population FROM series
UNION ALL SELECT 1000 + n_nationkey, y, CASE WHEN n_nationkey % 2 = 0 THEN 0.0 END FROM nation, (SELECT DISTINCT year_id AS y FROM series) WHERE n_regionkey = 1""")
def absent_locations(spark, sf):
    n = I.table(spark, sf, "nation").filter("n_regionkey = 1")
    extra = n.select((1000 + F.col("n_nationkey")).alias("location_id"), F.when(F.col("n_nationkey") % 2 == 0, R.ZERO).otherwise(R.UNMODELED).alias("category"))
    return R.add_absent_locations(I.series(spark, sf), extra).select("location_id", "year_id", F.round("population", 2).alias("population"))


@query("""WITH RECURSIVE parents AS (SELECT n_nationkey AS id, 100 + n_regionkey AS up FROM nation UNION ALL SELECT 100 + r_regionkey, 999 FROM region),
goals AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 100 UNION ALL SELECT 102 UNION ALL SELECT 999),
climb(id, at_, hop) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT c.id, p.up, c.hop + 1 FROM climb c JOIN parents p ON p.id = c.at_ WHERE c.at_ NOT IN (SELECT id FROM goals))
SELECT id AS location_id, CAST(at_ AS INT) AS ancestor_id FROM climb WHERE at_ IN (SELECT id FROM goals)""")
def hierarchy_climb(spark, sf):
    n, r = I.table(spark, sf, "nation"), I.table(spark, sf, "region")
    parents = n.select(F.col("n_nationkey").alias("location_id"), (100 + F.col("n_regionkey")).alias("parent_id")).union(r.select(100 + F.col("r_regionkey"), F.lit(999)))
    goals = n.filter("n_nationkey % 7 = 0").select(F.col("n_nationkey").alias("location_id")).union(spark.createDataFrame([(100,), (102,), (999,)], "location_id int"))
    return R.nearest_ancestor(n.select(F.col("n_nationkey").alias("location_id")), parents, goals).select("location_id", F.col("ancestor_id").cast("int").alias("ancestor_id"))


@query(f"""WITH {I.SERIES}, {I.ESTIMATES}, forecast AS (SELECT location_id + CASE WHEN location_id < 18 THEN 0 ELSE 100 END AS location_id, year_id, 2 * population AS population, 7 AS level FROM series WHERE year_id = 2002),
kept AS (SELECT * FROM estimates WHERE parent_id <> 101)
SELECT location_id, year_id, round(population, 2) AS population, 7 AS level FROM kept WHERE year_id <> 2002 AND location_id IN (SELECT location_id FROM forecast)
UNION ALL SELECT location_id, year_id, round(population, 2), level FROM forecast""")
def forecast_series(spark, sf):
    moved = F.col("location_id") + F.when(F.col("location_id") < 18, 0).otherwise(100)
    s = I.named(I.series(spark, sf).filter("year_id = 2002").withColumn("location_id", moved))
    forecast = s.withColumns({"population": 2 * F.col("population"), "level": F.lit(7), "most_detailed": F.lit(1), "parent_id": F.col("region_id")})
    drop = spark.createDataFrame([(101,)], "location_id int")
    return R.prepare_series(I.estimates(spark, sf), drop, forecast).select("location_id", "year_id", F.round("population", 2).alias("population"), "level")


@query("""WITH c AS (SELECT DISTINCT c_nationkey + CASE WHEN c_nationkey % 3 = 0 THEN 100 ELSE 0 END AS id FROM customer), s AS (SELECT DISTINCT s_nationkey + CASE WHEN s_nationkey % 4 = 1 THEN 200 ELSE 0 END AS id FROM supplier)
SELECT id AS location_id, 'shape' AS missing FROM c WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT id, 'population' FROM s WHERE id NOT IN (SELECT id FROM c)""")
def set_checks(spark, sf):
    c, s = F.col("c_nationkey"), F.col("s_nationkey")
    p = I.table(spark, sf, "customer").select((c + F.when(c % 3 == 0, 100).otherwise(0)).alias("location_id"))
    return R.unmatched(p, I.table(spark, sf, "supplier").select((s + F.when(s % 4 == 1, 200).otherwise(0)).alias("location_id")))


@query("""SELECT n_nationkey AS location_id, CASE WHEN n_nationkey % 6 = 0 THEN 77 WHEN n_nationkey % 2 = 0 THEN 100 + n_regionkey ELSE n_regionkey END AS region_id FROM nation""")
def region_mapping(spark, sf):
    n = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("location_id"), F.col("n_regionkey").alias("region_id"))
    tree = n.filter("location_id % 2 = 0").select("location_id", (100 + F.col("region_id")).alias("region_id"))
    return R.location_regions(n, tree, n.filter("location_id % 6 = 0").select("location_id", F.lit(77).alias("region_id")))


@query("""SELECT c_nationkey AS location_id, 'primary' AS source FROM customer WHERE c_nationkey NOT IN (3, 5, 8) AND c_nationkey % 2 = 1 GROUP BY 1
UNION ALL SELECT s_nationkey, 'fallback' FROM supplier WHERE s_nationkey < 20 AND NOT (s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_nationkey NOT IN (3, 5, 8) AND c_nationkey % 2 = 1)) GROUP BY 1""")
def shape_fallback(spark, sf):
    a = I.table(spark, sf, "customer").filter("c_nationkey % 2 = 1").select(F.col("c_nationkey").alias("location_id"), F.lit("primary").alias("source")).distinct()
    b = I.table(spark, sf, "supplier").filter("s_nationkey < 20").select(F.col("s_nationkey").alias("location_id"), F.lit("fallback").alias("source")).distinct()
    return R.raking_shapes(a, b, [3, 5, 8], I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("location_id")))


# Time

_WANTED = ("2000q1", "2000q3", "2001q2", "2003q4", "2007q2")


@query(f"""WITH {I.SERIES}, w(t) AS (VALUES {", ".join(f"('{t}')" for t in _WANTED)}),
a AS (SELECT t, least(CAST(t[1:4] AS INT), 2003) AS y0, least(CAST(t[1:4] AS INT) + 1, 2003) AS y1, (CAST(t[6:6] AS INT) - 1) / 4.0::double AS w FROM w)
SELECT p.location_id, t AS time_point, round((1 - w) * p.population + CASE WHEN w > 0 THEN w * q.population ELSE 0 END, 4) AS population
FROM a JOIN series p ON p.year_id = y0 LEFT JOIN series q ON q.location_id = p.location_id AND q.year_id = y1""")
def interp_quarter(spark, sf):
    wanted = spark.createDataFrame([(t,) for t in _WANTED], "time_point string")
    return rounded(timeaxis.quarterly(I.series(spark, sf), wanted).select("location_id", "time_point", "population"))


_VERSION_ROWS = ", ".join(f"('{v.name}', '{t}')" for v in BUILT_VERSIONS.values() for t in v.time_points)
_TIME_ROWS = ", ".join(f"('{t}')" for t in ALL_TIME_POINTS)


#: Quarters of orders, moved to where the versions are.
_ORDERED = "SELECT DISTINCT year(o_orderdate) + 3 * (o_custkey % 13) || 'q' || quarter(o_orderdate) AS time_point FROM orders"


def _ordered(spark, sf):
    d = F.col("o_orderdate")
    return I.table(spark, sf, "orders").select(K.time_point((F.year(d) + 3 * (F.col("o_custkey") % 13)).cast("int"), F.quarter(d)).alias("time_point")).distinct()


@query(f"""WITH v(version, t) AS (VALUES {_VERSION_ROWS}), a AS ({_ORDERED}),
b AS (SELECT version, min(t) AS lo, max(t) AS hi FROM v GROUP BY 1)
SELECT b.version, time_point, CASE WHEN v.t IS NOT NULL THEN 'process' WHEN time_point < lo OR time_point > hi THEN 'skip' ELSE 'interpolate' END AS strategy,
  CASE WHEN time_point < lo THEN lo WHEN time_point > hi THEN hi END AS copy_of
FROM b CROSS JOIN a LEFT JOIN v ON v.version = b.version AND v.t = time_point""")
def time_strategies(spark, sf):
    return timeaxis.strategies(spark, _ordered(spark, sf))


@query(f"""WITH a(time_point) AS (VALUES {_TIME_ROWS}), o AS (SELECT DISTINCT year(o_orderdate) || 'q' || quarter(o_orderdate) AS t FROM orders WHERE quarter(o_orderdate) < 3),
s AS (SELECT min(CAST(t[1:4] AS INT)) AS lo, max(CAST(t[1:4] AS INT)) AS hi FROM o),
x AS (SELECT time_point, CASE WHEN time_point IN (SELECT t FROM o) THEN time_point ELSE least(greatest(CAST(time_point[1:4] AS INT), lo), hi) || 'q1' END AS source FROM a, s)
SELECT *, source IN (SELECT t FROM o) AS available FROM x""")
def prediction_times(spark, sf):
    d = F.col("o_orderdate")
    have = I.table(spark, sf, "orders").filter(F.quarter(d) < 3).select(K.time_point(F.year(d), F.quarter(d)).alias("time_point"))
    return timeaxis.prediction_time(spark.createDataFrame([(t,) for t in ALL_TIME_POINTS], "time_point string"), have)


@query(f"""WITH v(version, t) AS (VALUES {_VERSION_ROWS}), a AS ({_ORDERED}),
n AS (SELECT version, t, lead(t) OVER (PARTITION BY version ORDER BY t) AS u FROM v),
f AS (SELECT *, CAST(time_point[1:4] AS INT) + (CAST(time_point[6:6] AS INT) - 1) / 4.0::double AS x, CAST(t[1:4] AS INT) + (CAST(t[6:6] AS INT) - 1) / 4.0::double AS a0, CAST(u[1:4] AS INT) + (CAST(u[6:6] AS INT) - 1) / 4.0::double AS a1
  FROM n JOIN a ON time_point >= t AND (u IS NULL OR time_point < u))
SELECT version, time_point, t AS t_from, u AS t_to, round(CASE WHEN u IS NULL OR x = a0 THEN 1 ELSE (a1 - x) / (a1 - a0) END, 6) AS weight FROM f""")
def time_weights(spark, sf):
    known = spark.createDataFrame([(v.name, t) for v in BUILT_VERSIONS.values() for t in v.time_points], "version string, time_point string")
    wanted = _ordered(spark, sf).crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in BUILT_VERSIONS], "version string")))
    return timeaxis.weights(wanted, known, ["version"]).select("version", "time_point", "t_from", "t_to", F.round("weight", 6).alias("weight"))


@query(f"""WITH {I.RASTER}
SELECT cell_group, "row", col, t AS time_point, round(CASE WHEN x < 0.01 THEN 0 ELSE x END, 5) AS value FROM (
  SELECT a.vec_id AS cell_group, a."row", a.col, t, CASE WHEN w = 1 THEN a.value ELSE a.value * w + b.value * (1 - w) END AS x
  FROM raster a JOIN raster b ON b.vec_id = a.vec_id + 1 AND b."row" = a."row" AND b.col = a.col
  CROSS JOIN (VALUES ('2000q1', 1.0::double), ('2002q3', 0.5::double), ('2003q4', 0.25::double)) v(t, w))""")
def raster_interpolation(spark, sf):
    # Each tile is the start of its own group and the end of the one before it.
    ends = F.array(F.struct(F.col("vec_id").alias("cell_group"), F.lit("2000q1").alias("time_point")), F.struct((F.col("vec_id") - 1).alias("cell_group"), F.lit("2005q1").alias("time_point")))
    values = I.raster(spark, sf).select(F.explode(ends).alias("e"), "row", "col", "value").select("e.cell_group", "row", "col", "e.time_point", "value")
    return _interpolated(spark, values)


def _interpolated(spark: SparkSession, values: DataFrame) -> DataFrame:
    values = values.withColumn("feature", F.lit("built"))
    both = values.groupBy("cell_group").agg(F.count_distinct("time_point").alias("n")).filter("n = 2").select("cell_group")
    wanted = spark.createDataFrame([("built", t) for t in ("2000q1", "2002q3", "2003q4")], "feature string, time_point string")
    return rounded(timeaxis.interpolate(values.join(both, "cell_group", "left_semi"), wanted, ["feature"], ["cell_group", "row", "col"]).drop("feature"), 5)


@query("""SELECT DISTINCT time_point FROM (SELECT y || 'q1' AS time_point FROM (SELECT unnest(range(1950, 2101)) AS y) UNION ALL SELECT year(o_orderdate) || 'q' || quarter(o_orderdate) FROM orders)""")
def extended_times(spark, sf):
    d = F.col("o_orderdate")
    return timeaxis.extended(I.table(spark, sf, "orders").select(K.time_point(F.year(d), F.quarter(d)).alias("time_point")))


@query("""SELECT o_orderkey, CAST(least(greatest(year(o_orderdate) + (o_orderkey % 60) - 20, 2000), 2022) AS INT) AS light_year FROM orders""")
def night_light_years(spark, sf):
    t = K.time_point(F.year("o_orderdate") + F.col("o_orderkey") % 60 - 20, F.lit(1))
    return I.table(spark, sf, "orders").select("o_orderkey", timeaxis.night_light_year(t).cast("int").alias("light_year"))


# Allocation

_ALLOCATED = f"""{I.INTERSECTIONS},
b AS (SELECT *, sum(pixel_value * isection_area) OVER (PARTITION BY admin_id) AS admin_built, min(tile_key) OVER (PARTITION BY admin_id) <> max(tile_key) OVER (PARTITION BY admin_id) AS admin_multi_tile FROM rows),
p AS (SELECT *, CASE WHEN admin_built = 0 THEN 0 ELSE admin_population * (pixel_value * isection_area / admin_built) END AS isection_population FROM b),
q AS (SELECT *, sum(isection_population) OVER (PARTITION BY tile_key, pixel_id) AS pixel_population, pixel_value * pixel_area AS pixel_built, (admin_population > 0 AND admin_built = 0) AS bad FROM p)"""


@query(f"""WITH {_ALLOCATED} SELECT admin_id, tile_key, pixel_id, admin_multi_tile, round(isection_population, 4) AS isection_population, round(pixel_population, 4) AS pixel_population,
  round(isection_area / admin_area, 6) AS admin_area_weight, round(isection_area / pixel_area, 6) AS pixel_area_weight, round(admin_population / admin_area, 6) AS admin_population_density,
  round(CASE WHEN bad THEN -1 WHEN admin_built = 0 THEN 0 ELSE admin_population / admin_built END, 5) AS admin_occupancy_rate,
  round(CASE WHEN bad THEN -1 WHEN admin_built = 0 THEN 0 ELSE ln(1 + admin_population / admin_built) END, 5) AS admin_log_occupancy_rate,
  round(CASE WHEN bad THEN -1 WHEN pixel_built = 0 THEN CASE WHEN pixel_population = 0 THEN 0 ELSE -9 END ELSE pixel_population / pixel_built END, 5) AS pixel_occupancy_rate FROM q""")
def allocate_population(spark, sf):
    a = allocate.allocate(I.intersections(spark, sf))
    a = a.withColumn("pixel_occupancy_rate", F.when(F.col("pixel_occupancy_rate") == S.INF, -9.0).otherwise(F.col("pixel_occupancy_rate")))
    return a.select(
        "admin_id", "tile_key", "pixel_id", "admin_multi_tile", *(F.round(c, 4).alias(c) for c in ("isection_population", "pixel_population")),
        *(F.round(c, 6).alias(c) for c in ("admin_area_weight", "pixel_area_weight", "admin_population_density")),
        *(F.round(c, 5).alias(c) for c in ("admin_occupancy_rate", "admin_log_occupancy_rate", "pixel_occupancy_rate")),
    )


@query(f"""WITH {_ALLOCATED} SELECT admin_id, round(max(admin_population), 2) AS admin_population, round(max(admin_built), 4) AS admin_built, bool_or(admin_multi_tile) AS admin_multi_tile,
  round(arg_min(isection_area / admin_area, (tile_key, pixel_id)), 6) AS admin_area_weight FROM q GROUP BY admin_id""")
def admin_one_row(spark, sf):
    one = allocate.one_per_admin(allocate.allocate(I.intersections(spark, sf)))
    return one.select("admin_id", F.round("admin_population", 2).alias("admin_population"), F.round("admin_built", 4).alias("admin_built"), "admin_multi_tile", F.round("admin_area_weight", 6).alias("admin_area_weight"))


@query(f"""WITH {_ALLOCATED}, f AS (SELECT tile_key, pixel_id, min(pixel_population) AS v FROM q GROUP BY 1, 2), t AS (SELECT DISTINCT tile_key FROM q), n AS (SELECT max(p_partkey) + 1 AS n FROM part)
SELECT g.tile_key, k AS pixel_id, round(coalesce(v, 0), 4) AS pixel_population FROM (SELECT tile_key, unnest(range(0, n)) AS k FROM t, n) g LEFT JOIN f ON f.tile_key = g.tile_key AND f.pixel_id = k""")
def pixel_densify(spark, sf):
    a = allocate.allocate(I.intersections(spark, sf))
    n = I.table(spark, sf, "part").agg((F.max("p_partkey") + 1).alias("n_pixels"))
    tiles = a.select("tile_key").distinct().crossJoin(F.broadcast(n))  # one row
    return rounded(allocate.densify(a, tiles, "pixel_population").withColumn("pixel_id", F.col("pixel_id").cast("long")))


@query(f"""WITH {_ALLOCATED}, f AS (SELECT p_partkey, 'size' AS feature, p_size::double AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part)
SELECT admin_id, feature, round(sum(v * isection_area / admin_area), 7) AS value FROM q JOIN f ON pixel_id = p_partkey GROUP BY 1, 2""")
def admin_feature_means(spark, sf):
    i = I.intersections(spark, sf)
    two = F.array(F.struct(F.lit("size").alias("feature"), F.col("p_size").cast("double").alias("value")), F.struct(F.lit("price").alias("feature"), F.col("p_retailprice").alias("value")))
    f = I.table(spark, sf, "part").select(F.col("p_partkey").alias("pixel_id"), F.explode(two).alias("f")).select("pixel_id", "f.*")
    f = f.join(i.select("tile_key", "pixel_id").distinct(), "pixel_id")
    return rounded(allocate.admin_features(i, f), 7)


@query(f"""WITH {_ALLOCATED}, u AS (SELECT admin_id, max(admin_population) AS p, max(admin_built) AS b, bool_or(admin_multi_tile) AS m FROM q GROUP BY 1),
l AS (SELECT label, count(*) FILTER (ok) AS units, coalesce(sum(p) FILTER (ok), 0) AS population FROM (
  SELECT p, unnest([{{'label': 'total', 'ok': true}}, {{'label': 'multi_tile', 'ok': m}}, {{'label': 'populated', 'ok': p > 0}}, {{'label': 'built', 'ok': b > 16}},
    {{'label': 'multi_tile_populated', 'ok': m AND p > 0}}, {{'label': 'multi_tile_built', 'ok': m AND b > 16}}], recursive := true) FROM u) GROUP BY label)
SELECT label, units, round(100.0 * units / (SELECT units FROM l WHERE label = 'total'), 4) AS units_percent, round(population, 2) AS population,
  round(100 * population / (SELECT population FROM l WHERE label = 'total'), 4) AS population_percent FROM l""")
def coverage_masks(spark, sf):
    c = allocate.coverage(allocate.allocate(I.intersections(spark, sf)))
    return c.select("label", "units", F.round("units_percent", 4).alias("units_percent"), F.round("population", 2).alias("population"), F.round("population_percent", 4).alias("population_percent"))


@query(f"""WITH {_ALLOCATED.replace("l_linenumber AS tile_key", "l_suppkey % 7 AS tile_key")} SELECT admin_id, tile_key, pixel_id FROM q WHERE NOT bad AND pixel_built > 0 AND pixel_population / pixel_built > 1e-3 AND NOT admin_multi_tile
UNION ALL SELECT admin_id, tile_key, pixel_id FROM q WHERE NOT bad AND pixel_built = 0 AND pixel_population > 0 AND NOT admin_multi_tile""")
def training_pixels(spark, sf):
    one_tile = I.intersections(spark, sf, "l_suppkey % 7")
    return allocate.training_pixels(allocate.allocate(one_tile)).select("admin_id", "tile_key", "pixel_id")


# Rasters

_BANDS = f"""{I.RASTER}, bands AS (
  SELECT d.label, d.vec_id, d."row", d.col, d.value AS d, CASE WHEN h.value < 0.05 THEN 0 ELSE 10 * h.value END AS h, p.value AS p FROM raster d
  JOIN raster h ON h.vec_id = d.vec_id + 1 AND h."row" = d."row" AND h.col = d.col JOIN raster p ON p.vec_id = d.vec_id + 2 AND p."row" = d."row" AND p.col = d.col WHERE d.vec_id % 3 = 0),
f AS (SELECT *, min(CASE WHEN h > 0 THEN h END) OVER (PARTITION BY label) AS lo FROM bands),
g AS (SELECT * REPLACE (CASE WHEN d >= 0.01 AND h = 0 THEN coalesce(lo, 2.4384) ELSE h END AS h) FROM f)"""


@query(f"""WITH {_BANDS} SELECT vec_id, "row", col, measure, round(value, 9) AS value FROM (SELECT vec_id, "row", col, unnest([{{'measure': 'density', 'value': d}}, {{'measure': 'residential_density', 'value': d * p}},
  {{'measure': 'nonresidential_density', 'value': d * (1 - p)}}, {{'measure': 'volume', 'value': h * d}}, {{'measure': 'residential_volume', 'value': h * d * p}}, {{'measure': 'nonresidential_volume', 'value': h * d * (1 - p)}}], recursive := true) FROM g)""")
def band_algebra(spark, sf):
    r = I.raster(spark, sf)
    third = lambda k, name, v: r.filter(F.col("vec_id") % 3 == k).select((F.col("vec_id") - k).alias("vec_id"), "row", "col", v.alias(name))
    d = r.filter("vec_id % 3 = 0").select(F.col("label").cast("string").alias("block_key"), "vec_id", (F.col("row") + 8 * F.col("vec_id")).cast("int").alias("r"), "row", "col", F.col("value").alias("density"))
    h = third(1, "height", F.when(F.col("value") < 0.05, 0.0).otherwise(10 * F.col("value")))
    bands = d.join(h, ["vec_id", "row", "col"]).join(third(2, "proportion_residential", F.col("value")), ["vec_id", "row", "col"])
    out = raster.derived_measures(bands.drop("row").withColumnRenamed("r", "row"))
    return out.select(F.floor(F.col("row") / 8).alias("vec_id"), (F.col("row") % 8).cast("int").alias("row"), "col", "measure", F.round("value", 9).alias("value"))


def _kernel_sql(radius: int, kind: str) -> str:
    rows = [(j - radius, i - radius, w) for i, line in enumerate(raster.kernel(1, radius, kind).tolist()) for j, w in enumerate(line) if w]
    return "k(dx, dy, w) AS (VALUES " + ", ".join(f"({x}, {y}, {w!r}::double)" for x, y, w in rows) + ")"


def _average_sql(radius: int, kind: str, digits: int = 4) -> str:
    return f"""WITH {I.RASTER}, {_kernel_sql(radius, kind)},
s AS (SELECT a.vec_id, a."row", a.col, sum(b.value * 1.0007 * w) AS v FROM raster a CROSS JOIN k JOIN raster b ON b.vec_id = a.vec_id AND b."row" + dy = a."row" AND b.col + dx = a.col GROUP BY 1, 2, 3),
m AS (SELECT *, v - min(v) OVER (PARTITION BY vec_id) AS x FROM s)
SELECT vec_id, "row", col, round(CASE WHEN x < 0.005 THEN 0 ELSE x END, {digits}) AS value FROM m"""


def _average(spark, sf, radius: int, kind: str) -> DataFrame:
    out = raster.average_by_offsets(I.raster(spark, sf).select("block_key", "row", "col", (F.col("value") * 1.0007).alias("value")), raster.kernel(1, radius, kind))
    return out.select(F.col("block_key").cast("long").alias("vec_id"), "row", "col", F.round("value", 4).alias("value"))


@query(_average_sql(2, "uniform"))
def spatial_average_uniform(spark, sf):
    return _average(spark, sf, 2, "uniform")


@query(_average_sql(2, "gaussian"))
def spatial_average_gaussian(spark, sf):
    return _average(spark, sf, 2, "gaussian")


@query(_average_sql(3, "gaussian", 3))
def spatial_average_tiles(spark, sf):
    tiles = I.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("block_key"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 3) * 1.0007).cast("array<double>").alias("data"))
    out = raster.average_tiles(tiles, 1, 3).select(F.col("block_key").cast("long").alias("vec_id"), F.posexplode("data").alias("k", "v"))
    return out.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).cast("int").alias("col"), F.round(F.col("v").cast("double"), 3).alias("value"))


@query(f"""WITH {I.RASTER} SELECT vec_id, "row" // 2 AS "row", col // 2 AS col, round(sum(value), 4) AS total, round(avg(value), 5) AS mean FROM raster GROUP BY 1, 2, 3""")
def resample_cells(spark, sf):
    r = I.raster(spark, sf).select("block_key", "row", "col", "value")
    total, mean = raster.resample(r, 2, "sum").withColumnRenamed("value", "total"), raster.resample(r, 2, "average").withColumnRenamed("value", "mean")
    return total.join(mean, ["block_key", "row", "col"]).select(F.col("block_key").cast("long").alias("vec_id"), "row", "col", F.round("total", 4).alias("total"), F.round("mean", 5).alias("mean"))


@query(f"""WITH {I.RASTER} SELECT CAST(floor((5 - (7.5 - "row")) / 2.5) AS INT) AS "row", CAST(floor(((col + 0.5) - 1) / 2.5) AS INT) AS col, label, round(sum(value), 4) AS value
FROM raster WHERE col + 0.5 >= 1 AND col + 0.5 < 6 AND 7.5 - "row" > 0 AND 7.5 - "row" <= 5 GROUP BY 1, 2, 3""")
def warp_sum(spark, sf):
    r = I.raster(spark, sf)
    parts = None
    for label in range(10):
        own = raster.warp(r.filter(F.col("label") == label), F.col("col") + 0.5, 7.5 - F.col("row"), (1.0, 0.0, 6.0, 5.0), 2.5, "sum").withColumn("label", F.lit(label))
        parts = own if parts is None else parts.unionByName(own)
    return parts.select("row", "col", "label", F.round("value", 4).alias("value"))


@query(f"""WITH {I.RASTER}, l1 AS (SELECT vec_id, "row" // 2 AS r, col // 2 AS c, avg(value) AS v FROM raster GROUP BY 1, 2, 3), l2 AS (SELECT vec_id, r // 2 AS r, c // 2 AS c, avg(v) AS v FROM l1 GROUP BY 1, 2, 3)
SELECT 1 AS level, vec_id, r AS "row", c AS col, round(v, 8) AS value FROM l1 UNION ALL SELECT 2, vec_id, r, c, round(v, 8) FROM l2""")
def overview_pyramid(spark, sf):
    a, b = raster.pyramid(I.raster(spark, sf).select("block_key", "row", "col", "value"), 2)
    both = a.withColumn("level", F.lit(1)).unionByName(b.withColumn("level", F.lit(2)))
    return both.select("level", F.col("block_key").cast("long").alias("vec_id"), "row", "col", F.round("value", 8).alias("value"))


@query("""SELECT 'B-' || lpad(CAST(vec_id % 25 AS VARCHAR), 4, '0') || 'X-' || lpad(CAST(vec_id // 25 AS VARCHAR), 4, '0') || 'Y' AS block_key,
  'G-' || lpad(CAST((vec_id % 25) // 10 AS VARCHAR), 4, '0') || 'X-' || lpad(CAST((vec_id // 25) // 10 AS VARCHAR), 4, '0') || 'Y' AS group_key, CAST(vec_id % 25 AS INT) AS bx, CAST(vec_id // 25 AS INT) AS "by" FROM embeddings""")
def mosaic_groups(spark, sf):
    e = I.table(spark, sf, "embeddings").select(K.block_key(F.col("vec_id") % 25, F.floor(F.col("vec_id") / 25)).alias("block_key"))
    return raster.mosaic(e).select("block_key", "group_key", K.block_x(F.col("block_key")).alias("bx"), K.block_y(F.col("block_key")).alias("by"))


@query(f"""WITH {I.RASTER} SELECT a.vec_id, a."row", a.col, CASE WHEN a.value >= 0.1 THEN a.value WHEN b.value >= 0.05 THEN b.value ELSE c.value END AS value FROM raster a
JOIN raster b ON b.vec_id = a.vec_id + 1 AND b."row" = a."row" AND b.col = a.col JOIN raster c ON c.vec_id = a.vec_id + 2 AND c."row" = a."row" AND c.col = a.col WHERE a.vec_id % 3 = 0""")
def merge_layers(spark, sf):
    r = I.raster(spark, sf)
    layer = lambda k, low: r.filter(F.col("vec_id") % 3 == k).select((F.col("vec_id") - k).cast("string").alias("block_key"), "row", "col", F.when(F.col("value") >= low, F.col("value")).alias("value"))
    whole = r.groupBy((F.col("vec_id") - F.col("vec_id") % 3).alias("v")).agg(F.count_distinct("vec_id").alias("n")).filter("n = 3").select(F.col("v").cast("string").alias("block_key"))
    out = raster.merge(layer(0, 0.1), layer(1, 0.05), layer(2, -1.0)).join(whole, "block_key", "left_semi")
    return out.select(F.col("block_key").cast("long").alias("vec_id"), "row", "col", "value")


@query(f"""WITH {I.RASTER}, h AS (SELECT * FROM raster WHERE value >= 0.2),
x AS (SELECT k.vec_id, k."row", k.col, k.value, arg_min(h.value, ((h."row" - k."row") ** 2 + (h.col - k.col) ** 2, h."row" - k."row", h.col - k.col)) AS near_ FROM raster k LEFT JOIN h
  ON h.vec_id = k.vec_id AND (h."row" - k."row") ** 2 + (h.col - k.col) ** 2 <= 16 GROUP BY ALL)
SELECT vec_id, "row", col, round(CASE WHEN value >= 0.2 THEN value ELSE near_ END, 3) AS value FROM x""")
def nearest_gap_fill(spark, sf):
    return _gap_fill(I.table(spark, sf, "embeddings"))


def _gap_fill(vectors: DataFrame) -> DataFrame:
    known = F.transform("embedding", lambda x: F.when(F.round(F.abs(x.cast("double")), 3) >= 0.2, F.round(F.abs(x.cast("double")), 3)).otherwise(F.lit(float("nan"))))
    tiles = vectors.select(F.col("vec_id").cast("string").alias("block_key"), F.lit(8).alias("height"), F.lit(8).alias("width"), known.alias("data"))
    out = raster.fill_nearest(tiles, 4).select(F.col("block_key").cast("long").alias("vec_id"), F.posexplode("data").alias("k", "v"))
    return out.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).cast("int").alias("col"), F.round(S.nan_to_null(F.col("v").cast("double")), 3).alias("value"))


@query(f"""WITH {I.RASTER} SELECT vec_id, "row", col, value, round(ln(1 + value), 6) AS log_value FROM raster""")
def night_lights(spark, sf):
    out = raster.night_lights(I.raster(spark, sf).select("block_key", "row", "col", "value"))
    return out.select(F.col("block_key").cast("long").alias("vec_id"), "row", "col", "value", F.round("log_value", 6).alias("log_value"))


@query(f"""WITH {I.RASTER} SELECT vec_id, "row" // 4 AS chunk_row, col // 4 AS chunk_col, round(list_sum(list(value ORDER BY "row", col)), 3) AS total, list(value ORDER BY "row", col)[6] AS sixth FROM raster GROUP BY 1, 2, 3""")
def chunked_tiles(spark, sf):
    t = raster.to_tiles(I.raster(spark, sf).select("block_key", "row", "col", "value"), 4, 4)
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + F.round(x.cast("double"), 3))
    return t.select(F.col("block_key").cast("long").alias("vec_id"), "chunk_row", "chunk_col", F.round(total, 3).alias("total"), F.round(F.element_at("data", 6).cast("double"), 3).alias("sixth"))


@query(f"""WITH {I.RASTER}, b AS (SELECT DISTINCT vec_id, vec_id % 5 AS bx, vec_id // 5 AS "by" FROM raster),
near_ AS (SELECT b.vec_id, n.vec_id AS other, (n.bx - b.bx) * 8 AS dx, (n."by" - b."by") * 8 AS dy
  FROM b CROSS JOIN (VALUES (-1), (0), (1)) x(i) CROSS JOIN (VALUES (-1), (0), (1)) y(j) JOIN b n ON n.bx = b.bx + i AND n."by" = b."by" + j)
SELECT near_.vec_id, CAST("row" + dy AS INT) AS "row", CAST(col + dx AS INT) AS col, value FROM near_ JOIN raster r ON r.vec_id = other WHERE col + dx BETWEEN -2 AND 9 AND "row" + dy BETWEEN -2 AND 9""")
def block_halo(spark, sf):
    return _halo(I.raster(spark, sf))


def _halo(r: DataFrame) -> DataFrame:
    blocks = r.select("block_key", (F.col("vec_id") % 5).cast("int").alias("block_x"), F.floor(F.col("vec_id") / 5).cast("int").alias("block_y")).distinct()
    return raster.with_halo(r.select("block_key", "row", "col", "value"), blocks, 8, 2).select(F.col("block_key").cast("long").alias("vec_id"), "row", "col", "value")


# Geometry


@query(f"""WITH {I.POINTS}, {I.edges_sql()}, {I.INSIDE} SELECT s.shape_id, round(coalesce(sum(y), 0), 3) AS value FROM (SELECT DISTINCT shape_id FROM edges) s LEFT JOIN inside USING (shape_id) GROUP BY 1""")
def zonal_sums(spark, sf):
    pts = I.points(spark, sf).withColumn("value", F.col("y"))
    return rounded(spatial_join.zonal_sum(pts, I.shapes(spark), 50.0, ["shape_id"]), 3)


@query(f"""WITH {I.POINTS}, {I.edges_sql()}, {I.INSIDE} SELECT p_partkey, arg_max(shape_id, ordinal) AS shape_id FROM pts LEFT JOIN inside USING (p_partkey) GROUP BY 1""")
def label_last_wins(spark, sf):
    return spatial_join.labelled(I.points(spark, sf), I.shapes(spark), 50.0, ["p_partkey"], "ordinal", "shape_id").select("p_partkey", "shape_id")


@query(f"""WITH {I.PART_EDGES}, c AS (SELECT *, unnest(range(CAST(floor(minx / 12.5) AS BIGINT), CAST(floor(maxx / 12.5) AS BIGINT) + 1)) AS cx FROM bounds),
r AS (SELECT *, unnest(range(CAST(floor(miny / 12.5) AS BIGINT), CAST(floor(maxy / 12.5) AS BIGINT) + 1)) AS cy FROM c),
o AS (SELECT shape_id, cx AS grid_col, cy AS grid_row, greatest(0, least(maxx, cx * 12.5 + 12.5) - greatest(minx, cx * 12.5)) * greatest(0, least(maxy, cy * 12.5 + 12.5) - greatest(miny, cy * 12.5)) AS a FROM r)
SELECT shape_id, grid_col, grid_row, round(a, 6) AS isection_area FROM o WHERE a > 0""")
def overlay_areas(spark, sf):
    """The bounds of parts' polygons cut by a grid."""
    boxes = G.with_bounds(I.part_shapes(spark, sf)).withColumn("geometry", G.st_box("minx", "miny", "maxx", "maxy"))
    return rounded(spatial_join.overlay(boxes, 12.5).select("shape_id", "grid_col", "grid_row", "isection_area"), 6)


@query(f"""WITH {I.PART_EDGES} SELECT shape_id, round(abs(sum(ax * by_ - bx * ay)) / 2, 4) AS area, min(ax) AS minx, max(ay) AS maxy FROM edges GROUP BY 1""")
def shape_areas(spark, sf):
    return G.with_bounds(I.part_shapes(spark, sf)).select("shape_id", F.round(G.st_area("geometry"), 4).alias("area"), "minx", "maxy")


@query(f"""WITH {I.edges_sql()}, b AS (SELECT shape_id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM edges GROUP BY 1),
t AS (SELECT p_partkey AS box_id, p_size::double AS bx0, p_retailprice AS by0, p_size + 2.0::double AS bx1, p_retailprice + 30 AS by1 FROM part)
SELECT shape_id, box_id FROM b JOIN t ON greatest(bx0 - x1, x0 - bx1, 0) ** 2 + greatest(by0 - y1, y0 - by1, 0) ** 2 <= 9""")
def tiles_near_shapes(spark, sf):
    s = F.col("p_size").cast("double")
    tiles = I.table(spark, sf, "part").select(F.col("p_partkey").alias("box_id"), s.alias("bx0"), F.col("p_retailprice").alias("by0"), (s + 2).alias("bx1"), (F.col("p_retailprice") + 30).alias("by1"))
    return spatial_join.pairs(I.shapes(spark, boxes=True), tiles, 50.0, 3.0).select("shape_id", "box_id")


@query("""WITH t AS (SELECT vec_id % 25 AS x, vec_id // 25 AS y FROM embeddings), b AS (SELECT x // 5 AS bx, y // 5 AS "by", min(x) * 10.0 AS x0, max(x) * 10.0 + 10 AS x1, min(y) * 10.0 AS y0, max(y) * 10.0 + 10 AS y1 FROM t GROUP BY 1, 2)
SELECT a.bx || '_' || a."by" AS block_key, n.bx || '_' || n."by" AS neighbour FROM b a JOIN b n ON greatest(n.x0 - a.x1, a.x0 - n.x1, 0) ** 2 + greatest(n.y0 - a.y1, a.y0 - n.y1, 0) ** 2 <= 625""")
def block_neighbours(spark, sf):
    return _neighbours(I.table(spark, sf, "embeddings"))


def _neighbours(vectors: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    x, y = v % 25, F.floor(v / 25)
    tiles = vectors.select(
        F.concat_ws("_", F.floor(x / 5), F.floor(y / 5)).alias("block_key"), (x * 10.0).alias("minx"), (y * 10.0).alias("miny"), (x * 10.0 + 10).alias("maxx"), (y * 10.0 + 10).alias("maxy")
    )
    return spatial_join.neighbours(spatial_join.dissolve(tiles, "block_key"), 25.0, 40.0)


@query("""WITH s AS (SELECT p_partkey, p_size + CASE WHEN p_partkey % 97 = 0 THEN 1000 ELSE 0 END AS w FROM part), m AS (SELECT quantile_cont(w, 0.5) AS m FROM s) SELECT p_partkey, w < 1.001 * m AS valid FROM s, m""")
def xspan_valid(spark, sf):
    w = F.col("p_size") + F.when(F.col("p_partkey") % 97 == 0, 1000).otherwise(0)
    return G.valid_spans(I.table(spark, sf, "part").select("p_partkey", F.lit(0.0).alias("minx"), w.cast("double").alias("maxx"))).select("p_partkey", "valid")


@query("""WITH p AS (SELECT p_partkey, ((p_partkey * 7919) % 36000) / 100.0::double - 180 AS lon, ((p_partkey * 104729) % 16000) / 100.0::double - 80 AS lat FROM part),
q AS (SELECT *, sin(radians(lat)) AS s, sqrt((2 - 1 / 298.257223563) / 298.257223563) AS e FROM p)
SELECT p_partkey, round(6378137 * radians(lon), 2) AS x, round(6378137 * (1 - e * e) * (s / (1 - e * e * s * s) + ln((1 + e * s) / (1 - e * s)) / (2 * e)) / 2, 2) AS y,
  round(6378137 * (ln((1 + s) / (1 - s)) - e * ln((1 + e * s) / (1 - e * s))) / 2, 2) AS mercator_y, round(lat, 6) AS latitude FROM q""")
def projections(spark, sf):
    k = F.col("p_partkey")
    p = I.table(spark, sf, "part").select("p_partkey", ((k * 7919) % 36000 / 100.0 - 180).alias("lon"), ((k * 104729) % 16000 / 100.0 - 80).alias("lat"))
    x, y = P.equal_area(F.col("lon"), F.col("lat"))
    return p.select("p_partkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.round(P.mercator(F.col("lon"), F.col("lat"))[1], 2).alias("mercator_y"), F.round(P.latitude(y), 6).alias("latitude"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey * 15.0 - 180 > 170 OR n_nationkey * 15.0 - 170 < -170 THEN 'equal_area_anti_meridian' ELSE 'equal_area' END AS crs FROM nation""")
def working_systems(spark, sf):
    n = F.col("n_nationkey")
    return I.table(spark, sf, "nation").select("n_nationkey", G.working_crs(n * 15.0 - 180, n * 15.0 - 170).alias("crs"))


# Census, summaries and histograms


def _cut_sql(x: str, edges) -> str:
    num = lambda e: f"'{'-' if e < 0 else ''}infinity'::double" if abs(e) == S.INF else f"{e}::double"
    parts = [f"WHEN {x} {'>=' if k == 0 else '>'} {num(a)} AND {x} <= {num(b)} THEN {k}" for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return f"CASE {' '.join(parts)} END"


_PRICES, _SIZES = (900, 1000, 1100, 1500, 2000), (1, 10, 20, 50)


@query(f"""WITH b AS (SELECT {_cut_sql("p_retailprice", _PRICES)} AS x, {_cut_sql("p_size", _SIZES)} AS y FROM part), c AS (SELECT * FROM b WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT i AS x_bin, j AS y_bin, round((SELECT count(*) FROM c WHERE x = i AND y = j) / (SELECT count(*) FROM c)::double, 8) AS share FROM (SELECT unnest(range(0, {len(_PRICES) - 1}))::INT AS i), (SELECT unnest(range(0, {len(_SIZES) - 1}))::INT AS j)""")
def cut_heatmap(spark, sf):
    return rounded(census.heatmap(I.table(spark, sf, "part"), "p_retailprice", "p_size", _PRICES, _SIZES), 8)


@query("""WITH u AS (SELECT c_custkey AS shape_id, CAST(c_custkey % 4 AS INT) AS admin_level, abs(c_acctbal) AS area, c_acctbal AS population_total FROM customer)
SELECT admin_level, count(shape_id) AS units, min(area) AS least_area, max(area) AS largest_area, round(avg(area), 5) AS mean_area, round((SELECT max(population_total) FROM u WHERE admin_level = 0) / count(shape_id), 6) AS mean_population FROM u GROUP BY 1""")
def admin_summary(spark, sf):
    u = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("shape_id"), (F.col("c_custkey") % 4).cast("int").alias("admin_level"), F.abs("c_acctbal").alias("area"), F.col("c_acctbal").alias("population_total"))
    s = census.summary(u)
    return s.select("admin_level", "units", "least_area", "largest_area", F.round("mean_area", 5).alias("mean_area"), F.round("mean_population", 6).alias("mean_population"))


@query("""SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem""")
def describe_prices(spark, sf):
    return rounded(census.describe(I.table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.9]))


@query("""SELECT CAST(least(floor((l_quantity - 5) / 2.5), 15) AS INT) AS bin, count(*) AS count FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 GROUP BY 1""")
def histogram_counts(spark, sf):
    return census.histogram(I.table(spark, sf, "lineitem"), "l_quantity", 5.0, 45.0, 16)


@query("""SELECT n_nationkey, list_has_any(string_split('0,' || n_regionkey || ',' || (100 + n_nationkey), ','), ['1', '104', '113']) AS under FROM nation""")
def path_filter(spark, sf):
    path = F.concat_ws(",", F.lit("0"), F.col("n_regionkey"), 100 + F.col("n_nationkey"))
    return I.table(spark, sf, "nation").select("n_nationkey", census.under(path, ["1", "104", "113"]).alias("under"))


@query("""WITH l AS (SELECT 'N' || c_nationkey AS iso3, CAST(2000 + c_custkey % 5 AS INT) AS "year", CAST(c_custkey % 3 AS INT) AS lev FROM customer WHERE c_nationkey % 4 <> 3 OR c_custkey % 3 <> 2)
SELECT iso3, "year" FROM l WHERE NOT (iso3 = 'N1' AND "year" = 2001) GROUP BY 1, 2 HAVING bool_or(lev = 0) AND bool_or(lev = 1) AND count(DISTINCT lev) > 2""")
def usable_countries(spark, sf):
    c = I.table(spark, sf, "customer").filter("c_nationkey % 4 <> 3 or c_custkey % 3 <> 2")
    levels = c.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("iso3"), (2000 + F.col("c_custkey") % 5).cast("int").alias("year"), (F.col("c_custkey") % 3).cast("int").alias("admin_level"))
    return census.usable_countries(levels, [("N1", 2001)])


@query("""SELECT 'N' || c_nationkey AS iso3, CAST(c_custkey % 7 AS INT) AS "year" FROM customer INTERSECT SELECT 'N' || s_nationkey, CAST(s_suppkey % 7 AS INT) FROM supplier""")
def iso_intersect(spark, sf):
    runs = lambda t, n, k: I.table(spark, sf, t).select(F.concat(F.lit("N"), F.col(n).cast("string")).alias("iso3"), (F.col(k) % 7).cast("int").alias("year"))
    return census.common_runs(runs("customer", "c_nationkey", "c_custkey"), runs("supplier", "s_nationkey", "s_suppkey"))


@query("""WITH p AS (SELECT c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 10000000 ELSE 0 END AS shape_id, c_acctbal AS population_total FROM customer), h AS (SELECT o_custkey + CASE WHEN o_custkey % 2 = 1 THEN 20000000 ELSE 0 END AS shape_id, sum(o_totalprice) AS household_total FROM orders GROUP BY 1)
SELECT shape_id, population_total, round(household_total, 2) AS household_total FROM p FULL JOIN h USING (shape_id)""")
def align_measures(spark, sf):
    c, o = F.col("c_custkey"), F.col("o_custkey")
    p = I.table(spark, sf, "customer").select((c + F.when(c % 3 == 0, 10_000_000).otherwise(0)).alias("shape_id"), F.col("c_acctbal").alias("value"))
    h = I.table(spark, sf, "orders").groupBy((o + F.when(o % 2 == 1, 20_000_000).otherwise(0)).alias("shape_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return census.align_measures({"population_total": p, "household_total": h})


@query("""SELECT n_nationkey AS shape_id, n_name, count(*) AS counted FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def census_join(spark, sf):
    shapes = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("shape_id"), "n_name")
    counts = I.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("shape_id")).agg(F.count(F.lit(1)).alias("counted"))
    return census.join_counts(shapes, counts, check=False)


@query("""WITH u AS (SELECT c_custkey, 'N' || c_nationkey AS iso3, CAST(c_custkey % (2 + c_nationkey % 3) AS INT) AS admin_level FROM customer WHERE c_acctbal > 100)
SELECT c_custkey, iso3, admin_level FROM u WHERE admin_level = (SELECT max(admin_level) FROM u x WHERE x.iso3 = u.iso3)""")
def deepest_units(spark, sf):
    u = I.table(spark, sf, "customer").filter("c_acctbal > 100").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("iso3"), (F.col("c_custkey") % (2 + F.col("c_nationkey") % 3)).cast("int").alias("admin_level"))
    return census.deepest(u).select("c_custkey", "iso3", "admin_level")


@query("""SELECT p_partkey, CAST(p_size AS INT) AS block_x FROM part WHERE p_size <= 8 OR p_size >= (SELECT max(p_size) FROM part) - 8""")
def anti_meridian_blocks(spark, sf):
    return census.near_anti_meridian(I.table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("block_x")))


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 30 AS INT) END AS label, p_retailprice AS v FROM part)
SELECT n_nationkey AS shape_id, 'N' || n_regionkey AS iso3, '2020' AS "year", round(coalesce((SELECT sum(v) FROM p WHERE label = n_nationkey + 10), 0), 2) AS population FROM nation""")
def census_metrics(spark, sf):
    p = I.table(spark, sf, "part").select(F.when(F.col("p_partkey") % 5 > 0, (F.col("p_partkey") % 30).cast("int")).alias("label"), F.col("p_retailprice").alias("value"))
    n = F.col("n_nationkey")
    units = I.table(spark, sf, "nation").select((n + 10).cast("int").alias("label"), n.alias("shape_id"), F.concat(F.lit("N"), F.col("n_regionkey").cast("string")).alias("iso3"), F.lit("2020").alias("year"))
    return rounded(census.pixel_metrics(p, units), 2)


# Scalars


@query(f"""SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE -9 END ELSE (p_partkey % 4) / (p_size % 5)::double END, 6) AS divided,
  CASE WHEN p_size / 1000.0 < 0.01 THEN 0 ELSE p_size / 1000.0::double END AS quiet, floor(p_retailprice * 10) / 10 AS floored, round(ln(1 + p_size), 6) AS logged,
  round(p_retailprice / pow(10, floor(log10(p_retailprice)) - 2)) * pow(10, floor(log10(p_retailprice)) - 2) AS three, {_cut_sql("p_size", _SIZES)} AS bin FROM part""")
def scalar_functions(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    d = S.safe_divide(k % 4, s % 5)
    return I.table(spark, sf, "part").select(
        "p_partkey", F.round(F.when(d == S.INF, -9.0).otherwise(d), 6).alias("divided"), S.suppress_noise(s / 1000.0).alias("quiet"),
        S.precise_floor("p_retailprice", 1).cast("double").alias("floored"), F.round(F.log1p(s), 6).alias("logged"), S.significant("p_retailprice", 3).alias("three"), S.cut("p_size", _SIZES).alias("bin"),
    )


@query("""SELECT o_orderkey, year(o_orderdate) || 'q' || quarter(o_orderdate) AS time_point, year(o_orderdate) + (quarter(o_orderdate) - 1) / 4.0::double AS value, 'AB_' || o_orderpriority[1:1] AS iso3, CAST(o_orderkey % 1000 AS INT) AS number FROM orders""")
def key_formats(spark, sf):
    t = K.time_point(F.year("o_orderdate"), F.quarter("o_orderdate"))
    name = F.concat(F.lit("AB_"), F.substring("o_orderpriority", 1, 1), F.lit("_"), F.year("o_orderdate").cast("string"))
    version = F.concat(F.lit("2025_06_21."), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    return I.table(spark, sf, "orders").select("o_orderkey", t.alias("time_point"), K.time_value(t).alias("value"), K.iso3_of(name).alias("iso3"), K.version_number(version).alias("number"))


# The model

_TRUTH = "d AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH {_TRUTH} SELECT round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) ** 2) / 1e6, 4) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(sqrt(avg((y - p) ** 2)) / (max(y) - min(y)), 6) AS nrmsd,
  round(avg(abs(y - p) / y), 6) AS mape, round(avg(2 * abs(y - p) / (abs(y) + abs(p))), 6) AS smape, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 6) AS r2 FROM d""")
def metrics_all(spark, sf):
    d = I.table(spark, sf, "lineitem").join(I.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    y, p = F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")
    digits, scale = {"mae": 4, "mse": 4, "rmse": 4}, {"mse": 1e6}
    return d.agg(*(F.round(f(y, p) / scale.get(k, 1), digits.get(k, 6)).alias(k) for k, f in METRICS.items()))


_Z, _B, _A = "(l_quantity / 10)", "l_discount", "1600.0::double"
_TRANSFORM_SQL = {
    "occupancy_rate": (_Z, f"ln({_Z})", f"{_Z} * {_B} * {_A}", f"{_Z} * {_B}", f"ln({_Z}) + ln({_B})"),
    "log_occupancy_rate": (f"exp({_Z})", _Z, f"exp({_Z}) * {_B} * {_A}", f"exp({_Z}) * {_B}", f"{_Z} + ln({_B})"),
    "population": (f"{_Z} / ({_B} * {_A})", f"ln({_Z}) - ln({_B}) - ln({_A})", _Z, f"{_Z} / {_A}", f"ln({_Z}) - ln({_A})"),
    "population_density": (f"{_Z} / {_B}", f"ln({_Z}) - ln({_B})", f"{_Z} * {_A}", _Z, f"ln({_Z})"),
    "log_population_density": (f"exp({_Z}) / {_B}", f"{_Z} - ln({_B})", f"exp({_Z}) * {_A}", f"exp({_Z})", _Z),
}


def _transform(kind: str) -> Query:
    def run(spark, sf):
        lines = I.table(spark, sf, "lineitem").filter("l_discount > 0")
        out = targets(kind, F.col("l_quantity") / 10, F.col("l_discount"))
        return lines.select("l_orderkey", "l_linenumber", *(F.round(out[t], 7).alias(t) for t in TARGETS))

    run.__name__ = f"transform_{kind}"
    return run


for _kind, _columns in _TRANSFORM_SQL.items():
    query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'round({c}, 7) AS {t}' for t, c in zip(TARGETS, _columns))} FROM lineitem WHERE l_discount > 0")(_transform(_kind))


@query(f"""WITH {I.INTERSECTIONS}, s AS (SELECT admin_id, sum(pixel_value * isection_area / admin_area) AS o, sum(isection_area * isection_area / admin_area) AS p FROM rows GROUP BY 1)
SELECT admin_id, round(o, 9) AS occupancy_rate, round(p, 7) AS population, round(p / 1600, 13) AS population_density, round(CASE WHEN p = 0 THEN NULL ELSE ln(p / 1600) END, 5) AS log_population_density FROM s""")
def area_targets(spark, sf):
    i = I.intersections(spark, sf).withColumn("pixel_id", F.concat_ws("-", "pixel_id", "admin_id"))
    px = i.select("tile_key", "pixel_id", F.col("pixel_value").alias("occupancy_rate"), F.col("isection_area").alias("population"))
    out = to_areas(px, i.select("admin_id", "tile_key", "pixel_id", (F.col("isection_area") / F.col("admin_area")).alias("weight")))
    return out.select("admin_id", F.round("occupancy_rate", 9).alias("occupancy_rate"), F.round("population", 7).alias("population"), F.round("population_density", 13).alias("population_density"), F.round("log_population_density", 5).alias("log_population_density"))


def _share_sql(salt: str) -> str:
    return f"(CAST('0x' || substr(md5('{salt}' || c_custkey), 1, 8) AS BIGINT) / 4294967296.0::double)"


@query(" UNION ALL ".join(
    f"SELECT c_custkey, CASE WHEN {_share_sql(f'test-{k}-')} < 0.2 THEN 'test' WHEN {_share_sql(f'validate-{k}-')} < 0.1 * (1 - 0.2) THEN 'validate' ELSE 'train' END AS split, {k} AS split_number FROM customer" for k in range(model.SPLITS)
))
def tile_splits(spark, sf):
    return model.splits(I.table(spark, sf, "customer"), "c_custkey")


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('split-0-' || c_custkey), c_custkey) AS k, count(*) OVER () AS n FROM customer), m AS (SELECT *, ceil(0.2::double * n) AS t FROM r)
SELECT c_custkey, CASE WHEN k <= t THEN 'test' WHEN k <= t + ceil(0.1::double * (1 - 0.2::double) * (n - t)) THEN 'validate' ELSE 'train' END AS split FROM m""")
def ranked_splits(spark, sf):
    return model.ranked_split(I.table(spark, sf, "customer"), 0, "c_custkey")


@query("""WITH m AS (SELECT quantile_cont(ln(l_quantity), 0.5) AS b FROM lineitem WHERE l_quantity > 0) SELECT l_orderkey, l_linenumber, round(exp(b) * l_discount, 6) AS population FROM lineitem, m""")
def median_model(spark, sf):
    lines = I.table(spark, sf, "lineitem")
    fitted = model.fit_least_absolute(lines.filter("l_quantity > 0").withColumn("y", F.ln("l_quantity")), "y")
    return model.predict(lines, fitted, "l_discount").select("l_orderkey", "l_linenumber", F.round("population", 6).alias("population"))


@query()
def linear_model(spark, sf):
    """Least absolute deviations with two features; iterative, so there is no SQL for it."""
    lines = I.table(spark, sf, "lineitem").filter("l_quantity > 0")
    y = F.ln("l_extendedprice")
    fitted = model.fit_least_absolute(lines.select(y.alias("y"), F.ln("l_quantity").alias("q"), F.col("l_discount").alias("d")), "y", ["q", "d"])
    return spark.createDataFrame([("intercept", fitted.intercept), *fitted.weights.items()], "feature string, weight double")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def unfinished_blocks(spark, sf):
    done = I.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return model.todo(I.table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


# Streaming


@query("""SELECT user_id, event_type, round(sum(value), 3) AS value, count(*) AS pixels FROM events GROUP BY 1, 2""")
def streamed_zonal_sums(spark, sf):
    """The events as a stream, in one pass to its end; the sums that the last batch leaves."""
    import uuid

    from popquilt.streaming import zonal

    at = f"{shared_folder(spark)}/zonal-{uuid.uuid4().hex}"
    schema = I.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(sf if sf.endswith(".parquet") else f"{sf}/events.parq[u]et")
    zonal.start(zonal.running_sums(stream, ["user_id", "event_type"]), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return zonal.latest(spark.read.parquet(f"{at}/out"), ["user_id", "event_type"]).select("user_id", "event_type", F.round("value", 3).alias("value"), "pixels")
