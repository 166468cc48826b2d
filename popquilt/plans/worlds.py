"""Queries that go through the catalog and the stages: tables are written, read back and worked on, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.functions import keys as K
from popquilt.functions import projections as P
from popquilt.functions import semantics as S
from popquilt.functions.constants import CRS
from popquilt.operators import allocate, census, model, pixel_model, raster, spatial_join, timeaxis
from popquilt.operators import geometry as G
from popquilt.operators import polygons as PG
from popquilt.operators import raking_population as R
from popquilt.plans import inputs as I
from popquilt.plans import stages
from popquilt.plans.catalogue import _ALLOCATED, query, rounded
from popquilt.session import shared_folder
from popquilt.sources.catalog import Catalog

SIDE = 8  # cells of a block
#: A grid of blocks of 25 columns, one for each vector; rows count downwards from y = 0.
GRID = f"""{I.RASTER}, world AS (SELECT vec_id, vec_id % 25 AS bx, vec_id // 25 AS "by", "row", col, (vec_id % 25) * 8 + col AS gx, (vec_id // 25) * 8 + "row" AS gy, value FROM raster)"""


def new_catalog(spark: SparkSession) -> Catalog:
    cat = Catalog(spark, f"{shared_folder(spark)}/world-{uuid.uuid4().hex}")
    cat.write_info("frame", {"cell": 1.0, "crs": "equal_area"})
    return cat


def block_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors as tiles of 8 by 8 cells in the grid of blocks."""
    v = F.col("vec_id")
    x, y = v % 25, F.floor(v / 25)
    return I.table(spark, sf, "embeddings").select(
        K.block_key(x, y).alias("block_key"), F.lit(0).alias("chunk_row"), F.lit(0).alias("chunk_col"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"),
        F.array(*(c.cast("double") for c in (x * SIDE, F.lit(1), -y * SIDE, F.lit(-1)))).alias("transform"), F.lit("equal_area").alias("crs"), F.lit(-1.0).alias("nodata"),
        F.transform("embedding", lambda a: F.round(F.abs(a.cast("double")), 3).cast("float")).alias("data"),
    )


def vec_id(block: str = "block_key"):
    return (K.block_x(F.col(block)) + 25 * K.block_y(F.col(block))).cast("long").alias("vec_id")


# Reading and writing


@query(f"""WITH {GRID} SELECT vec_id, "row", col, gx + 0.5 AS x, -gy - 0.5 AS y, CASE WHEN value >= 0.02 THEN value END AS value FROM world""")
def tile_pixels(spark, sf):
    """A tile table as pixels; what is marked as no-data is missing."""
    low = F.transform("data", lambda v: F.when(F.round(v.cast("double"), 3) < 0.02, -1.0).otherwise(v.cast("double")).cast("float"))
    p = raster.pixels(block_tiles(spark, sf).withColumn("data", low))
    return p.select(vec_id(), "row", "col", "x", "y", F.round("value", 3).alias("value"))


_UNITS = """u AS (SELECT c_custkey AS shape_id, 'N' || c_nationkey AS iso3, CAST(2000 + c_custkey % 3 AS VARCHAR) AS year, CAST(c_custkey % 4 AS INT) AS admin_level,
  c_custkey % 100 AS minx, c_custkey % 37 AS miny, c_custkey % 100 + 5 AS maxx, c_custkey % 37 + 5 AS maxy, c_acctbal AS population_total FROM customer)"""


def _units(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    bounds = [c.cast("double").alias(n) for n, c in (("minx", k % 100), ("miny", k % 37), ("maxx", k % 100 + 5), ("maxy", k % 37 + 5))]
    return I.table(spark, sf, "customer").select(
        k.alias("shape_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("iso3"), (2000 + k % 3).cast("string").alias("year"),
        (k % 4).cast("int").alias("admin_level"), *bounds, F.col("c_acctbal").alias("population_total"),
    )


@query(f"""WITH {_UNITS} SELECT shape_id, iso3, population_total FROM u WHERE year = '2001' AND maxx >= 20 AND minx <= 40 AND maxy >= 10 AND miny <= 20""")
def census_by_bounds(spark, sf):
    """Units written by country and year, and read back by year and bounds."""
    cat = new_catalog(spark)
    cat.write(_units(spark, sf), "census")
    return cat.read("census", bounds=(20, 10, 40, 20), year="2001").select("shape_id", "iso3", "population_total")


@query(f"""WITH {_UNITS}, d AS (SELECT iso3, year, max(admin_level) AS l FROM u GROUP BY 1, 2)
SELECT iso3, year, l AS deepest_level, (SELECT count(*) FROM u WHERE u.iso3 = d.iso3 AND u.year = d.year) AS units FROM d""")
def census_listing(spark, sf):
    """Countries and years that are there, and each one's deepest level."""
    cat = new_catalog(spark)
    cat.write(_units(spark, sf), "census")
    have = cat.values("census", "iso3", "year").withColumn("year", F.col("year").cast("string"))
    units = cat.read("census").withColumn("year", F.col("year").cast("string"))
    return have.join(units.groupBy("iso3", "year").agg(F.max("admin_level").alias("deepest_level"), F.count("shape_id").alias("units")), ["iso3", "year"])


@query(f"""WITH {_UNITS} SELECT shape_id, round(population_total, 2) AS value FROM u""")
def census_csv(spark, sf):
    """Counts written as CSV and read with the fixed schema."""
    path = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    _units(spark, sf).select(F.col("shape_id").cast("string").alias("shape_id"), F.col("population_total").alias("value")).write.csv(path, header=True)
    return new_catalog(spark).read_counts(path).select(F.col("shape_id").cast("long").alias("shape_id"), F.round("value", 2).alias("value"))


@query(f"""WITH {_UNITS}, x AS (SELECT iso3, year, CASE WHEN year = '2001' THEN -1 ELSE sum(population_total) END AS p FROM u GROUP BY 1, 2) SELECT iso3, year, round(p, 2) AS population_total FROM x""")
def overwritten_partitions(spark, sf):
    """Writing a table again replaces the partitions that the new rows are of, and no others."""
    cat = new_catalog(spark)
    sums = _units(spark, sf).groupBy("iso3", "year").agg(F.sum("population_total").alias("population_total"))
    cat.write(sums, "census")
    cat.write(sums.filter("year = '2001'").withColumn("population_total", F.lit(-1.0)), "census")
    return cat.read("census").select("iso3", F.col("year").cast("string").alias("year"), F.round("population_total", 2).alias("population_total"))


@query("""SELECT n_nationkey AS location_id, n_name AS location_name, r_name AS source FROM nation JOIN region ON n_regionkey = r_regionkey""")
def ingested_sources(spark, sf):
    """Tables from outside under one column, with the standard names."""
    cat = new_catalog(spark)
    n, r = I.table(spark, sf, "nation"), I.table(spark, sf, "region")
    names = {row["r_regionkey"]: row["r_name"] for row in r.collect()}  # five regions
    cat.ingest({name: n.filter(F.col("n_regionkey") == k).select(F.col("n_nationkey").alias("loc_id"), F.col("n_name").alias("location_name")) for k, name in names.items()}, "hierarchies", "source")
    return cat.read("hierarchies").select("location_id", "location_name", "source")


@query(f"""WITH {GRID}, f(feature, time_point, v) AS (VALUES ('built', '2000q1', 0), ('built', '1990q1', 0), ('log_built', '2000q1', 1))
SELECT vec_id, "row", col, feature, time_point, round(CASE WHEN v = 1 THEN ln(1 + value) ELSE value END, 4) AS value FROM world, f""")
def feature_views(spark, sf):
    """A feature as it is, through an alias of another time point, and as its logarithm."""
    cat = new_catalog(spark)
    cat.write(block_tiles(spark, sf), "features", resolution="100", feature="built", time_point="2000q1")
    cat.link("100", "built", "1990q1", "built", "2000q1")
    out = None
    for name, time in (("built", "2000q1"), ("built", "1990q1"), ("log_built", "2000q1")):
        own = raster.pixels(cat.feature("100", name, time)).select(vec_id(), "row", "col", F.lit(name).alias("feature"), F.lit(time).alias("time_point"), F.round("value", 4).alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""WITH v AS (SELECT '2025_06_' || lpad(CAST(1 + c_custkey % 3 AS VARCHAR), 2, '0') AS d, c_custkey % 40 AS n FROM customer)
SELECT d || '.' || lpad(CAST(max(n) AS VARCHAR), 3, '0') AS version, d || '.' || lpad(CAST(max(n) + 1 AS VARCHAR), 3, '0') AS next_version FROM v GROUP BY d""")
def last_versions(spark, sf):
    """The last version of a day, and the one after it."""
    from datetime import date

    cat = new_catalog(spark)
    k = F.col("c_custkey")
    name = F.concat(F.lit("2025_06_"), F.lpad((1 + k % 3).cast("string"), 2, "0"), F.lit("."), F.lpad((k % 40).cast("string"), 3, "0"))
    cat.write(I.table(spark, sf, "customer").select(name.alias("version"), F.lit("{}").alias("text")).distinct(), "specifications", resolution="100")
    days = [date(2025, 6, d) for d in (1, 2, 3)]
    return spark.createDataFrame([(cat.last_version("100", d), cat.next_version("100", d)) for d in days], "version string, next_version string")


# Rasters across blocks


@query("""WITH p AS (SELECT l_orderkey % 1024 AS r, (l_partkey * 7 + l_linenumber) % 1024 AS c, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT CAST(r // 512 AS INT) AS chunk_row, CAST(c // 512 AS INT) AS chunk_col, CAST((r % 512) * 512 + c % 512 AS INT) AS place, v AS value FROM p""")
def whole_tiles(spark, sf):
    """Scattered pixels gathered into chunks of 512 by 512, and the known ones read back by their place."""
    r, c = F.col("l_orderkey") % 1024, (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 1024
    long = I.table(spark, sf, "lineitem").select(F.lit("b").alias("block_key"), r.cast("int").alias("row"), c.cast("int").alias("col"), F.col("l_quantity").alias("value"))
    tiles = raster.to_tiles(long, 512, 512)
    known = tiles.select("chunk_row", "chunk_col", F.posexplode("data").alias("place", "value")).filter("value is not null")
    return known.withColumn("value", F.col("value").cast("double"))


def _kernel(radius: int, kind: str) -> str:
    w = raster.kernel(1, radius, kind)
    r = len(w) // 2
    return "k(dx, dy, w) AS (VALUES " + ", ".join(f"({j - r}, {i - r}, {v!r}::double)" for i, line in enumerate(w.tolist()) for j, v in enumerate(line) if v) + ")"


@query(f"""WITH {GRID}, {_kernel(3, "gaussian")},
s AS (SELECT t.vec_id, t."row", t.col, sum(coalesce(o.value, 0) * w) AS v FROM world t CROSS JOIN k LEFT JOIN world o ON o.gx = t.gx + dx AND o.gy = t.gy + dy GROUP BY 1, 2, 3),
m AS (SELECT *, v - min(v) OVER (PARTITION BY vec_id) AS x FROM s)
SELECT vec_id, "row", col, round(CASE WHEN x < 0.005 THEN 0 ELSE x END, 3) AS value FROM m""")
def averages_across_blocks(spark, sf):
    """Neighbourhood averages as the stage makes them: a cell at a block's edge sees the next block."""
    cat = new_catalog(spark)
    cat.write(block_tiles(spark, sf), "features", resolution="100", feature="built", time_point="2000q1")
    stages.averages(cat, "100", "built", "2000q1", [3.0])
    p = raster.pixels(cat.feature("100", "built_3m", "2000q1"))
    return p.select(vec_id(), "row", "col", F.round(F.col("value"), 3).alias("value"))


@query(f"""WITH {GRID}, h AS (SELECT * FROM world WHERE value >= 0.2),
o AS (SELECT unnest(range(-2, 3)) AS dx), n AS (SELECT o.dx, p.dx AS dy FROM o, o p WHERE o.dx ** 2 + p.dx ** 2 <= 4),
x AS (SELECT k.vec_id, k."row", k.col, k.value, arg_min(h.value, (dx ** 2 + dy ** 2, dy, dx)) FILTER (h.value IS NOT NULL) AS near_ FROM world k CROSS JOIN n LEFT JOIN h ON h.gx = k.gx + dx AND h.gy = k.gy + dy GROUP BY ALL)
SELECT vec_id, "row", col, round(coalesce(CASE WHEN value >= 0.2 THEN value ELSE near_ END, 0), 3) AS value FROM x""")
def filled_night_lights(spark, sf):
    """Night lights as the stage makes them: gaps take the nearest light within two cells, in their own block or the next, and what is left is dark."""
    return _filled(spark, sf, 2, "nearest").withColumn("value", F.round("value", 3))


def _filled(spark, sf, distance: int, how: str) -> DataFrame:
    cat = new_catalog(spark)
    some = F.transform("data", lambda v: F.when(F.round(v.cast("double"), 3) < 0.2, -1.0).otherwise(v.cast("double")).cast("float"))
    cat.write(block_tiles(spark, sf).withColumn("data", some), "tiles", resolution="100", provider="nightlights", time_point="2022q1")
    stages.night_lights(cat, "100", ["2024q3"], distance=distance, how=how)
    p = raster.pixels(cat.feature("100", "nighttime_lights", "2024q3"))
    return p.select(vec_id(), "row", "col", "value")


@query(f"""WITH {GRID}, h AS (SELECT * FROM world WHERE value >= 0.2),
o AS (SELECT unnest(range(-3, 4)) AS d), n AS (SELECT o.d AS dx, p.d AS dy, o.d ** 2 + p.d ** 2 AS far, (CASE WHEN o.d > 0 THEN 1 ELSE 0 END) + (CASE WHEN p.d > 0 THEN 2 ELSE 0 END) AS quadrant FROM o, o p WHERE o.d ** 2 + p.d ** 2 <= 9),
q AS (SELECT k.vec_id, k."row", k.col, quadrant, arg_min(h.value, (far, abs(dx))) AS v, min(far) AS far FROM world k CROSS JOIN n JOIN h ON h.gx = k.gx + dx AND h.gy = k.gy + dy WHERE k.value < 0.2 GROUP BY ALL),
f AS (SELECT vec_id, "row", col, sum(v / sqrt(far)) / sum(1 / sqrt(far)) AS v FROM q GROUP BY ALL)
SELECT vec_id, "row", col, round(0.7071067812::double * CASE WHEN value >= 0.2 THEN value ELSE coalesce(v, 0) END, 2) AS value FROM world LEFT JOIN f USING (vec_id, "row", col)""")
def interpolated_night_lights(spark, sf):
    """Gaps take the mean of the nearest lights of four quadrants within three cells, weighted by 1 / distance, also across blocks.

    Stored values have seven digits, so that they are rounded to two, off the halves of a digit that means of a few are.
    """
    return _filled(spark, sf, 3, "interpolate").withColumn("value", F.round(0.7071067812 * F.col("value"), 2))


# The model's stages


def _predicted(spark, sf) -> tuple[Catalog, str]:
    cat, version = new_catalog(spark), "2025_06_21.001"
    cat.write(block_tiles(spark, sf), "features", resolution="100", feature="built", time_point="2020q1")
    cat.write_specification(model.Specification("built", "100", version=version))
    cat.write_model(model.Linear(0.5), "100", version)
    stages.inference(cat, "100", version, ["2020q1"])
    return cat, version


@query(f"""WITH {GRID} SELECT vec_id, "row", col, round(exp(0.5::double) * value, 4) AS value FROM world""")
def predicted_blocks(spark, sf):
    """Specification and model read back, blocks predicted and written, and read through a copy of the version."""
    cat, version = _predicted(spark, sf)
    stages.inference(cat, "100", version, ["2020q1"])  # finished blocks are left alone
    cat.copy_version("100", "2025_06_21.002", version)
    p = raster.pixels(cat.raw_predictions("100", "2025_06_21.002", "2020q1"))
    return p.select(vec_id(), "row", "col", F.round("value", 4).alias("value"))


_RAKED = f"""{GRID}, labelled AS (SELECT *, CASE WHEN gx + 0.5 >= 50 AND gx + 0.5 < 150 THEN 2 WHEN gx + 0.5 < 100 THEN 1 END AS location_id FROM world),
f AS (SELECT location_id, location_id * 1000 / sum(value) AS factor FROM labelled WHERE location_id IS NOT NULL GROUP BY 1)"""


def _raked(spark, sf) -> tuple[Catalog, str]:
    cat, version = _predicted(spark, sf)
    shapes = [(k, bytearray(G.write_wkb(G.box(x0, -1e6, x1, 1e6)))) for k, x0, x1 in ((1, 0, 100), (2, 50, 150))]
    cat.write(G.with_bounds(spark.createDataFrame(shapes, "location_id int, geometry binary")), "raking_shapes", version="primary")
    cat.write(spark.createDataFrame([(k, y, k * 1000.0) for k in (1, 2) for y in (2020, 2021)], "location_id int, year_id int, population double"), "raking_population", version="primary")
    stages.raking_factors(cat, "100", version, ["2020q1"])
    stages.rake(cat, "100", version, ["2020q1"])
    return cat, version


@query(f"""WITH {_RAKED} SELECT vec_id, "row", col, round(value * factor, 2) AS value FROM labelled LEFT JOIN f USING (location_id)""")
def raked_blocks(spark, sf):
    """Predictions raked to two overlapping locations, of which the last one wins; missing outside."""
    cat, version = _raked(spark, sf)
    p = raster.pixels(cat.read("raked_predictions", resolution="100", version=version))
    return p.select(vec_id(), "row", "col", F.round("value", 2).alias("value"))


@query(f"""WITH {_RAKED} SELECT DISTINCT vec_id, location_id, round(factor / exp(0.5::double), 6) AS raking_factor FROM labelled JOIN f USING (location_id)""")
def block_factors(spark, sf):
    """Factors by block and location, written and read back."""
    cat, version = _raked(spark, sf)
    return cat.raking_factors("100", version, "2020q1").select(vec_id(), "location_id", F.round("raking_factor", 6).alias("raking_factor"))


@query(f"""WITH {_RAKED}, k AS (SELECT unnest([0, 1]) AS k), p AS (SELECT value * factor AS v, gx + 20037508.34::double AS a, gy + 6363885.33::double AS b FROM labelled JOIN f USING (location_id)),
c AS (SELECT floor(b / 1000) + y.k AS r, floor(a / 1000) + x.k AS c, v, greatest(0, least(a + 1, (floor(a / 1000) + x.k + 1) * 1000) - greatest(a, (floor(a / 1000) + x.k) * 1000))
  * greatest(0, least(b + 1, (floor(b / 1000) + y.k + 1) * 1000) - greatest(b, (floor(b / 1000) + y.k) * 1000)) AS w FROM p, k x, k y)
SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col, round(sum(v * w), 1) AS value FROM c WHERE w > 1e-12 GROUP BY 1, 2""")
def upsampled_cells(spark, sf):
    """Raked pixels dealt out to an output grid's cells by area."""
    cat, version = _raked(spark, sf)
    stages.upsample(cat, "100", version, "2020q1", "world_cylindrical_1000")
    return cat.read("compiled_predictions", spec="world_cylindrical_1000").select("row", "col", F.round("value", 1).alias("value"))


@query(f"""WITH {GRID}, k AS (SELECT unnest(range(-1, 5)) AS k), p AS (SELECT value AS v, (gx + 3) / 0.75::double AS a, (gx + 4) / 0.75::double AS z, (gy + 2) / 0.75::double AS b, (gy + 3) / 0.75::double AS y FROM world),
c AS (SELECT floor(b) + r.k AS "row", floor(a) + c.k AS col, v, greatest(0, least(z, floor(a) + c.k + 1) - greatest(a, floor(a) + c.k)) * greatest(0, least(y, floor(b) + r.k + 1) - greatest(b, floor(b) + r.k)) AS w FROM p, k r, k c)
SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, round(sum(v * w) / sum(w), 4) AS value FROM c WHERE w > 1e-9 GROUP BY 1, 2""")
def averaged_footprints(spark, sf):
    """Pixels averaged by area on a grid that is finer than they are: it has no holes."""
    p = raster.pixels(block_tiles(spark, sf))
    x, y = F.col("x"), F.col("y")
    out = raster.warp_footprints(p.withColumn("value", F.round("value", 3)), (x - 0.5, y - 0.5, x + 0.5, y + 0.5), (-3.0, -1e5, 1e5, 2.0), 0.75, "average")
    return out.select("row", "col", F.round("value", 4).alias("value"))


_PARTS = """d AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validate' ELSE 'test' END AS split, l_quantity / 10.0::double AS y, exp(0.1::double + l_discount) * (l_tax + 0.01) * 100 AS p FROM lineitem)"""


@query(f"""WITH {_PARTS} SELECT split, count(*) AS "rows", round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse FROM d GROUP BY 1""")
def split_scores(spark, sf):
    """A model's output turned into people and compared with the truth, for each part of a split."""
    part = F.when(F.col("l_linenumber") % 3 == 0, "train").when(F.col("l_linenumber") % 3 == 1, "validate").otherwise("test")
    rows = I.table(spark, sf, "lineitem").select(part.alias("tile_key"), (F.col("l_quantity") / 10).alias("y"), F.col("l_discount"), (F.col("l_tax") + 0.01).alias("built"))
    parts = spark.createDataFrame([(p, p) for p in model.TRAIN_NAMES], "tile_key string, split string")
    fitted = model.Linear(0.1, {"l_discount": 1.0})
    out = model.scores(rows, parts, fitted, "log_occupancy_rate", "population", "y", area=100.0, metrics=("mae", "rmse"))
    return out.select("split", "rows", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@query("""WITH d AS (SELECT l_quantity AS y, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS o FROM lineitem), m AS (SELECT o, quantile_cont(y, 0.5) AS m FROM d GROUP BY 1)
SELECT count(*) AS "rows", round(avg(abs(y - m)), 2) AS loss FROM d JOIN m USING (o)""")
def linear_model_loss(spark, sf):
    """Least absolute deviations with an indicator: no line is nearer than the two groups' medians, and the fit is as near."""
    lines = I.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("o"))
    fitted = model.fit_least_absolute(lines, "y", ["o"])
    return lines.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.abs(F.col("y") - fitted.output())), 2).alias("loss"))


_SUPPLIED = """r AS (SELECT l_suppkey AS unit, l_quantity / 50 AS w, l_tax + 0.01 AS b, l_discount AS x, l_extendedprice FROM lineitem),
u AS (SELECT unit, sum(w * b * 100) AS a, sum(w * b * 100 * x) AS c, sum(l_extendedprice) / 1e5 AS y FROM r GROUP BY 1)"""


def _supplied(spark, sf) -> DataFrame:
    """Lines as pixels of suppliers, which have people; all are training units."""
    lines = I.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), F.lit("train").alias("split"), (F.col("l_quantity") / 50).alias("weight"), (F.col("l_tax") + 0.01).alias("built"), "l_discount", "l_extendedprice")
    people = lines.groupBy("unit").agg((F.sum("l_extendedprice") / 1e5).alias("y"))
    return lines.join(people, "unit").withColumn("odd", (F.col("unit") % 2).cast("double"))


@query(f"""WITH {_SUPPLIED}, m AS (SELECT sum(a * a) AS aa, sum(a * c) AS ac, sum(c * c) AS cc, sum(a * y) AS ay, sum(c * y) AS cy FROM u)
SELECT unit, round(y, 4) AS y, round(a * (ay * cc - cy * ac) / (aa * cc - ac * ac) + c * (cy * aa - ay * ac) / (aa * cc - ac * ac), 3) AS population FROM u, m""")
def pixel_model_linear(spark, sf):
    """Rates of pixels, linear in a feature of theirs, fitted to units' people: the normal equations' solution in the SQL."""
    rows = _supplied(spark, sf)
    fitted = pixel_model.fit(rows, "occupancy_rate", "population", ["l_discount"], "mse", area=100.0).model
    return pixel_model.predictions(rows, "occupancy_rate", "population", fitted, 100.0).select("unit", F.round("y", 4).alias("y"), F.round("p", 3).alias("population"))


@query(f"""WITH {_SUPPLIED}, m AS (SELECT unit % 2 AS o, sum(a * y) / sum(a * a) AS e FROM u GROUP BY 1) SELECT unit, round(y, 4) AS y, round(a * e, 3) AS population FROM u JOIN m ON o = unit % 2""")
def pixel_model_exponential(spark, sf):
    """Logarithms of rates fitted to units' people through the exponential: with an indicator of the unit, each kind of unit has a solution of its own."""
    rows = _supplied(spark, sf)
    fitted = pixel_model.fit(rows, "log_occupancy_rate", "population", ["odd"], "mse", area=100.0, tolerance=1e-14).model
    return pixel_model.predictions(rows, "log_occupancy_rate", "population", fitted, 100.0).select("unit", F.round("y", 4).alias("y"), F.round("p", 3).alias("population"))


@query("""WITH l AS (SELECT p_partkey AS location_id, p_partkey - p_partkey % 40 AS up FROM part) SELECT location_id, g.p_partkey AS ancestor_id FROM l LEFT JOIN part g ON g.p_partkey = up AND up % 80 = 0""")
def long_climb(spark, sf):
    """Chains of forty levels, of which each second one has a goal at its top."""
    k = F.col("p_partkey")
    parts = I.table(spark, sf, "part").select(k.alias("location_id"), F.when(k % 40 != 0, k - 1).alias("parent_id"))
    return R.nearest_ancestor(parts.select("location_id"), parts, parts.filter("location_id % 80 = 0").select("location_id"))


@query("""WITH u AS (SELECT c_custkey AS shape_id, 'N' || c_nationkey AS iso3, CAST(2000 + c_custkey % 3 * 10 AS INT) AS "year", CAST(c_custkey % (2 + (c_custkey % 3 + c_nationkey) % 3) AS INT) AS admin_level FROM customer)
SELECT * FROM u WHERE admin_level = (SELECT max(admin_level) FROM u v WHERE v.iso3 = u.iso3 AND v."year" = u."year")""")
def deepest_of_censuses(spark, sf):
    """The deepest level of each census: a country's later one may be deeper than the one before."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    u = I.table(spark, sf, "customer").select(k.alias("shape_id"), F.concat(F.lit("N"), n.cast("string")).alias("iso3"), (2000 + k % 3 * 10).cast("int").alias("year"), (k % (2 + (k % 3 + n) % 3)).cast("int").alias("admin_level"))
    return census.deepest(u, ("iso3", "year")).select("shape_id", "iso3", "year", "admin_level")


@query(f"""WITH {_RAKED}, p AS (SELECT gx, value * factor AS v FROM labelled LEFT JOIN f USING (location_id)), u AS (SELECT 's' || k AS shape_id, '2020' AS "year", k * 20 AS a, k * 20 + 20 AS b FROM (SELECT unnest(range(12)) AS k) UNION ALL SELECT 'whole', '2010', 0, 200)
SELECT shape_id, 'AAA' AS iso3, "year", round(coalesce((SELECT sum(v) FROM p WHERE gx >= a AND gx < b), 0), 1) AS population FROM u""")
def raked_units(spark, sf):
    """Raked pixels summed to the deepest units of two censuses, of which the later one is deeper."""
    cat, version = _raked(spark, sf)
    boxes = [(f"s{k}", "2020", 1, 20.0 * k, 20.0 * k + 20) for k in range(12)] + [("whole", "2010", 0, 0.0, 200.0), ("left out", "2020", 0, 0.0, 240.0)]
    units = spark.createDataFrame([(s, "AAA", y, lev, bytearray(G.write_wkb(G.box(a, -1e5, b, 1e3)))) for s, y, lev, a, b in boxes], "shape_id string, iso3 string, year string, admin_level int, geometry binary")
    cat.write(G.with_bounds(units), "census")
    stages.metrics(cat, "100", [version], "2020q1")
    return cat.read("raw_validation", version=version).select("shape_id", "iso3", F.col("year").cast("string").alias("year"), F.round("population", 1).alias("population"))


# Filters and expressions


@query(f"""WITH {_ALLOCATED} SELECT admin_id, tile_key, pixel_id, round(min(isection_area / admin_area), 8) AS weight FROM q GROUP BY 1, 2, 3""")
def pixel_area_weights(spark, sf):
    return rounded(allocate.pixel_weights(allocate.allocate(I.intersections(spark, sf))), 8)


@query(f"""WITH {_ALLOCATED.replace("l_linenumber AS tile_key", "l_suppkey % 7 AS tile_key")}, t AS (SELECT DISTINCT l_suppkey % 7 AS tile_key FROM lineitem WHERE l_suppkey % 7 <> 3)
SELECT DISTINCT admin_id, tile_key FROM q SEMI JOIN t USING (tile_key) WHERE admin_population > 0 AND admin_built > 0 AND NOT admin_multi_tile""")
def units_to_train_on(spark, sf):
    a = allocate.allocate(I.intersections(spark, sf, "l_suppkey % 7"))
    tiles = I.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("tile_key")).filter("tile_key <> 3")
    return allocate.training_units(a, tiles).select("admin_id", "tile_key").distinct()


@query(f"""WITH {_ALLOCATED}, one AS (SELECT admin_id, max(admin_population) AS population, max(admin_built) AS built FROM q GROUP BY 1)
SELECT admin_id, s_name AS geometry, round(population, 2) AS population, round(built, 4) AS density, round(CASE WHEN built = 0 THEN 0 ELSE 100 * population / built END, 4) AS occupancy_percent FROM one JOIN supplier ON s_suppkey = admin_id""")
def units_with_geometry(spark, sf):
    """Units with short names, their geometry joined to them again, and people per hundred of built area."""
    one = allocate.one_per_admin(allocate.allocate(I.intersections(spark, sf)))
    short = model.renamed(one, "density").select("admin_id", "population", "density")
    shapes = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("admin_id"), F.col("s_name").alias("geometry"))
    percent = S.finite_or(S.safe_divide(100 * F.col("population"), "density"))
    return allocate.with_geometry(short, shapes).select("admin_id", "geometry", F.round("population", 2).alias("population"), F.round("density", 4).alias("density"), F.round(percent, 4).alias("occupancy_percent"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE round(p_retailprice / (p_partkey % 3), 4) END AS finite FROM part""")
def finite_values(spark, sf):
    k = F.col("p_partkey")
    return I.table(spark, sf, "part").select("p_partkey", F.round(S.finite_or(S.safe_divide("p_retailprice", k % 3)), 4).alias("finite"))


@query("""SELECT DISTINCT 'N' || c_nationkey AS iso3, CAST(c_custkey % 7 AS INT) AS "year" FROM customer WHERE c_nationkey = 7""")
def runs_of_a_country(spark, sf):
    runs = I.table(spark, sf, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("iso3"), (F.col("c_custkey") % 7).cast("int").alias("year")).distinct()
    return census.select_runs(runs, "n7")


@query("""SELECT n_nationkey, wanted FROM nation, (VALUES ('N1'), ('N2'), ('NX'), ('X1')) v(wanted)
WHERE CASE WHEN n_nationkey < 20 THEN 'N' || n_nationkey ELSE 'X1_' || n_nationkey END = wanted
  OR (wanted NOT IN ('N1', 'N2') AND starts_with(CASE WHEN n_nationkey < 20 THEN 'N' || n_nationkey ELSE 'X1_' || n_nationkey END, wanted))""")
def locations_of_a_country(spark, sf):
    """Locations with a country's code, or those whose code starts with it where none has it."""
    k = F.col("n_nationkey")
    n = I.table(spark, sf, "nation").select("n_nationkey", F.when(k < 20, F.concat(F.lit("N"), k.cast("string"))).otherwise(F.concat(F.lit("X1_"), k.cast("string"))).alias("location_code"))
    out = None
    for code in ("N1", "N2", "NX", "X1"):
        own = census.country_locations(n, code).select("n_nationkey", F.lit(code).alias("wanted"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT DISTINCT year(o_orderdate) + 26 || 'q' || quarter(o_orderdate) AS time_point FROM orders WHERE starts_with(CAST(year(o_orderdate) + 26 AS VARCHAR), '202')""")
def recent_times(spark, sf):
    d = F.col("o_orderdate")
    return timeaxis.recent(I.table(spark, sf, "orders").select(K.time_point(F.year(d) + 26, F.quarter(d)).alias("time_point")).distinct())


@query("""WITH u AS (SELECT c_custkey, 'N' || c_nationkey AS iso3, CAST(c_custkey % (2 + c_nationkey % 3) AS INT) AS admin_level FROM customer)
SELECT c_custkey, iso3, admin_level FROM (SELECT *, dense_rank() OVER (PARTITION BY iso3 ORDER BY admin_level DESC) AS k FROM u) WHERE k <= 2""")
def last_two_levels(spark, sf):
    n = F.col("c_nationkey")
    u = I.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("N"), n.cast("string")).alias("iso3"), (F.col("c_custkey") % (2 + n % 3)).cast("int").alias("admin_level"))
    return census.last_levels(u).select("c_custkey", "iso3", "admin_level")


@query("""WITH b AS (SELECT n_nationkey, n_nationkey * 10.0 - 180 AS x0, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 10.0 - 60 ELSE n_nationkey * 10.0 - 175 END AS x1 FROM nation)
SELECT n_nationkey, CASE WHEN x1 - x0 > 100 THEN x1 ELSE x0 END AS x0, CASE WHEN x1 - x0 > 100 THEN x0 + 360 ELSE x1 END AS x1 FROM b""")
def unwrapped_spans(spark, sf):
    n = F.col("n_nationkey")
    low, high = n * 10.0 - 180, F.when(n % 3 == 0, n * 10.0 - 60).otherwise(n * 10.0 - 175)
    return I.table(spark, sf, "nation").select("n_nationkey", G.unwrapped(low, high).alias("b")).select("n_nationkey", "b.x0", "b.x1")


@query("""WITH p AS (SELECT p_partkey, radians(((p_partkey * 7919) % 36000) / 100.0::double - 180) AS lon, radians(((p_partkey * 104729) % 16000) / 100.0::double - 80) AS lat FROM part)
SELECT p_partkey, round(6378137 * lon, 2) AS x, round(6378137 * ln(tan(pi() / 4 + lat / 2)), 2) AS y FROM p""")
def web_mercator(spark, sf):
    k = F.col("p_partkey")
    x, y = P.project("webmerc", (k * 7919) % 36000 / 100.0 - 180, (k * 104729) % 16000 / 100.0 - 80, 0)
    return I.table(spark, sf, "part").select("p_partkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


# Polygons as they are


#: The area of a polygon within a cell: along each edge in the cell's band of y, what lies right of the left side and left of the edge.
_CELL_AREA = """p AS (SELECT *, greatest(least(ay, by_), y0) AS lo, least(greatest(ay, by_), y1) AS hi FROM edges JOIN cells USING (shape_id) WHERE ay <> by_),
q AS (SELECT *, ax + (lo - ay) / (by_ - ay) * (bx - ax) AS xl, ax + (hi - ay) / (by_ - ay) * (bx - ax) AS xh FROM p WHERE hi > lo),
g AS (SELECT *, CASE WHEN xl <= x0 THEN 0 WHEN xl >= x1 THEN (x1 - x0) * (xl - x1) + (x1 - x0) ** 2 / 2 ELSE (xl - x0) ** 2 / 2 END AS gl,
  CASE WHEN xh <= x0 THEN 0 WHEN xh >= x1 THEN (x1 - x0) * (xh - x1) + (x1 - x0) ** 2 / 2 ELSE (xh - x0) ** 2 / 2 END AS gh FROM q),
areas AS (SELECT shape_id, cx, cy, abs(sum(sign(by_ - ay) * (hi - lo) * CASE WHEN xl = xh THEN least(greatest(xl, x0), x1) - x0 ELSE (gh - gl) / (xh - xl) END)) AS a FROM g GROUP BY 1, 2, 3)"""


@query(f"""WITH {I.PART_EDGES}, cc AS (SELECT *, unnest(range(CAST(floor(minx / 12.5) AS BIGINT), CAST(floor(maxx / 12.5) AS BIGINT) + 1)) AS cx FROM bounds),
cr AS (SELECT *, unnest(range(CAST(floor(miny / 12.5) AS BIGINT), CAST(floor(maxy / 12.5) AS BIGINT) + 1)) AS cy FROM cc), cells AS (SELECT shape_id, cx, cy, cx * 12.5 AS x0, cx * 12.5 + 12.5 AS x1, cy * 12.5 AS y0, cy * 12.5 + 12.5 AS y1 FROM cr),
{_CELL_AREA} SELECT shape_id, cx AS grid_col, cy AS grid_row, round(0.7071067812::double * a, 4) AS scaled_area FROM areas WHERE a > 1e-6""")
def overlay_polygons(spark, sf):
    """Polygons that are no rectangles cut by a grid; areas are scaled, for many are halves of the last digit."""
    cut = spatial_join.overlay(G.with_bounds(I.part_shapes(spark, sf)), 12.5)
    return cut.select("shape_id", "grid_col", "grid_row", F.round(0.7071067812 * F.col("isection_area"), 4).alias("scaled_area"))


@query(f"""WITH {I.PART_EDGES}, cells AS (SELECT shape_id, 0 AS cx, 0 AS cy, 30 AS x0, 90.5 AS x1, 20 AS y0, 70.25 AS y1 FROM bounds), {_CELL_AREA} SELECT shape_id, round(a, 6) AS area FROM areas WHERE a > 1e-6""")
def clipped_shapes(spark, sf):
    """What is left of parts' polygons in a window."""
    box = [F.lit(v) for v in (30.0, 20.0, 90.5, 70.25)]
    cut = I.part_shapes(spark, sf).select("shape_id", G.st_clip("geometry", *box).alias("piece")).filter("piece is not null")
    return cut.select("shape_id", F.round(G.st_area("piece"), 6).alias("area"))


@query(f"""WITH {I.PART_EDGES} SELECT shape_id, round(CASE shape_id % 3 WHEN 1 THEN w * h / 2 ELSE w * h END, 6) AS area, 1 AS parts, len(ring) AS corners FROM pr""")
def hulls_and_parts(spark, sf):
    """Convex hulls' areas (a notch is filled up), and the parts with their corners."""
    corners = F.pandas_udf(G.count_corners, "long")
    s = I.part_shapes(spark, sf).select("shape_id", F.round(G.st_area(G.st_hull("geometry")), 6).alias("area"), G.st_parts("geometry").alias("p"))
    return s.select("shape_id", "area", F.size("p").alias("parts"), corners(F.element_at("p", 1)).alias("corners"))


# Polygons made of parts


def _ring(*points):
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def _triangles(spark, sf) -> DataFrame:
    """Halves of squares on whole numbers, below or above the falling diagonal."""
    k, s = F.col("p_partkey"), 1 + F.col("p_size") % 6
    x, y = (k * 7) % 60, (k * 13) % 50
    low, high = _ring((x, y), (x + s, y), (x, y + s)), _ring((x + s, y), (x + s, y + s), (x, y + s))
    p = I.table(spark, sf, "part").select((k % 20).alias("group"), F.when(k % 3 == 0, high).otherwise(low).alias("ring"))
    return p.select("group", G.st_polygon("ring").alias("geometry"))


@query("""WITH t AS (SELECT p_partkey % 20 AS g, p_partkey % 3 = 0 AS up, (p_partkey * 7) % 60 AS x, (p_partkey * 13) % 50 AS y, 1 + p_size % 6 AS s FROM part),
c AS (SELECT *, unnest(range(0, s)) AS i FROM t), d AS (SELECT *, unnest(range(0, s)) AS j FROM c), h AS (SELECT *, unnest([0, 1]) AS half FROM d),
n AS (SELECT DISTINCT g, x + i AS a, y + j AS b, half FROM h WHERE CASE WHEN up THEN i + j + half >= s ELSE i + j + half + 1 <= s END)
SELECT g AS "group", round(count(*) / 2.0, 4) AS area FROM n GROUP BY 1""")
def dissolved_triangles(spark, sf):
    """Overlapping and touching triangles as one polygon a group: half squares that any of them covers, counted in the SQL."""
    out = PG.union(_triangles(spark, sf), ["group"], 16.0)
    return out.select("group", F.round(G.st_area("geometry"), 4).alias("area"))


@query("""SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN w * h / 2 ELSE w * h END, 4) AS area, p_partkey % 3 <> 2 AS faulty
FROM (SELECT p_partkey, 1.0 + p_size AS w, 2.0 + p_partkey % 7 AS h FROM part)""")
def repaired_shapes(spark, sf):
    """Boxes whose ring crosses itself, boxes with a spike, and valid ones."""
    k = F.col("p_partkey")
    x, y, w, h = k % 100, F.floor(k / 100) * 1.0, 1.0 + F.col("p_size"), 2.0 + k % 7
    tie, spike, plain = _ring((x, y), (x + w, y + h), (x + w, y), (x, y + h)), _ring((x, y), (x + w, y), (x + w + 3, y), (x + w, y), (x + w, y + h), (x, y + h)), _ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    p = I.table(spark, sf, "part").select(k, F.when(k % 3 == 0, tie).when(k % 3 == 1, spike).otherwise(plain).alias("ring"))
    p = p.select("p_partkey", G.st_polygon("ring").alias("geometry"))
    wrong = PG.faults(p, ["p_partkey"], 32.0).select("p_partkey", F.lit(True).alias("faulty")).distinct()
    done = PG.repaired(p, ["p_partkey"], 32.0).select("p_partkey", F.round(G.st_area("geometry"), 4).alias("area"))
    return done.join(wrong, "p_partkey", "left").select("p_partkey", "area", F.coalesce("faulty", F.lit(False)).alias("faulty"))


@query(f"""SELECT p_partkey, round(w * h + 2 * (w + h) * 0.75 + {PG.ROUND} / 2 * sin(2 * pi() / {PG.ROUND}) * 0.75 ** 2, 3) AS area FROM (SELECT p_partkey, 1.0::double + p_size AS w, 2.0::double + p_partkey % 7 AS h FROM part)""")
def buffered_boxes(spark, sf):
    """Boxes grown by a distance: the box, a strip along each side, and a circle in four quarters."""
    k = F.col("p_partkey")
    w, h = 1.0 + F.col("p_size"), 2.0 + k % 7
    p = I.table(spark, sf, "part").select(k, G.st_box(F.lit(0.0), F.lit(0.0), w, h).alias("geometry"))
    return PG.buffered(p, ["p_partkey"], 0.75, 64.0).select("p_partkey", F.round(G.st_area("geometry"), 3).alias("area"))


@query("""WITH b AS (SELECT p_partkey, (p_partkey * 7919) % 3600 / 10.0::double - 180 AS x, (p_partkey * 104729) % 1200 / 10.0::double - 65 AS y, 1.0::double + p_size % 9 AS w FROM part),
q AS (SELECT *, sin(radians(y)) AS s0, sin(radians(y + 5)) AS s1, 0.0818191908426215::double AS e FROM b),
a AS (SELECT *, (1 - e * e) * (s0 / (1 - e * e * s0 * s0) + ln((1 + e * s0) / (1 - e * s0)) / (2 * e)) AS q0, (1 - e * e) * (s1 / (1 - e * e * s1 * s1) + ln((1 + e * s1) / (1 - e * s1)) / (2 * e)) AS q1 FROM q)
SELECT p_partkey, CASE WHEN x < 180 AND x + w > 180 THEN 2 ELSE 1 END AS parts, round(6378.137::double * radians(w) * 6378.137 * (q1 - q0) / 2, 2) AS square_km FROM a""")
def reprojected_boxes(spark, sf):
    """Boxes in degrees in an equal-area system; those that cross the anti-meridian, written with longitudes below 180, are in two parts."""
    k = F.col("p_partkey")
    x, y, w = (k * 7919) % 3600 / 10.0 - 180, (k * 104729) % 1200 / 10.0 - 65, 1.0 + F.col("p_size") % 9
    right = F.when(x + w > 180, x + w - 360).otherwise(x + w)
    p = I.table(spark, sf, "part").select(k, _ring((x, y), (right, y), (right, y + 5), (x, y + 5)).alias("ring")).select("p_partkey", G.st_polygon("ring").alias("geometry"))
    out = PG.reprojected(p, CRS["equal_area"], 10.0)
    return out.select("p_partkey", F.size(G.st_parts("geometry")).alias("parts"), F.round(G.st_area("geometry") / 1e6, 2).alias("square_km"))


def _segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Squared distance of a point and a segment in SQL."""
    t = f"greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2)))"
    return f"({ax} + {t} * ({bx} - {ax}) - {px}) ** 2 + ({ay} + {t} * ({by} - {ay}) - {py}) ** 2"


_CORNERS = [("bx0", "by0"), ("bx1", "by0"), ("bx1", "by1"), ("bx0", "by1")]


@query(f"""WITH {I.edges_sql()}, t AS (SELECT p_partkey AS box_id, p_size::double AS bx0, p_retailprice AS by0, p_size + 2.0::double AS bx1, p_retailprice + 30 AS by1 FROM part),
e AS (SELECT shape_id, box_id, least({", ".join(_segment(x, y, "ax", "ay", "bx", "by_") for x, y in _CORNERS)}, {", ".join(_segment("ax", "ay", *a, *b) for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1]))}) AS d,
  greatest(0, CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN bx0 AND bx1 THEN 0 ELSE 2 END ELSE least((bx0 - ax) / (bx - ax), (bx1 - ax) / (bx - ax)) END, CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN by0 AND by1 THEN 0 ELSE 2 END ELSE least((by0 - ay) / (by_ - ay), (by1 - ay) / (by_ - ay)) END) AS enter,
  least(1, CASE WHEN bx = ax THEN 1 ELSE greatest((bx0 - ax) / (bx - ax), (bx1 - ax) / (bx - ax)) END, CASE WHEN by_ = ay THEN 1 ELSE greatest((by0 - ay) / (by_ - ay), (by1 - ay) / (by_ - ay)) END) AS leave,
  CASE WHEN (ay > by0) <> (by_ > by0) AND ay <> by_ AND bx0 < (bx - ax) * (by0 - ay) / nullif(by_ - ay, 0) + ax THEN 1 ELSE 0 END AS crossing FROM edges CROSS JOIN t)
SELECT shape_id, box_id FROM e GROUP BY 1, 2 HAVING min(d) <= 9 OR bool_or(enter <= leave) OR sum(crossing) % 2 = 1""")
def near_polygons(spark, sf):
    """Boxes within a distance of polygons that are no rectangles: they meet, one holds the other, or an edge is near."""
    s = F.col("p_size").cast("double")
    tiles = I.table(spark, sf, "part").select(F.col("p_partkey").alias("box_id"), s.alias("bx0"), F.col("p_retailprice").alias("by0"), (s + 2).alias("bx1"), (F.col("p_retailprice") + 30).alias("by1"))
    return spatial_join.pairs(I.shapes(spark), tiles, 50.0, 3.0).select("shape_id", "box_id")
