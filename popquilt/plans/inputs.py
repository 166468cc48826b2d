"""The benchmark tables read as the engine's entities, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Series of population: (location_id, region_id, year_id, population), nations as locations.
SERIES = """series AS (
  SELECT n_nationkey AS location_id, 100 + n_regionkey AS region_id, CAST(2000 + c_custkey % 4 AS INT) AS year_id, sum(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END) AS population
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    money = F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal"))
    return (
        table(spark, sf, "customer")
        .groupBy("c_nationkey", (2000 + F.col("c_custkey") % 4).cast("int").alias("year_id"))
        .agg(F.sum(money).alias("population"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_nationkey").alias("location_id"), (100 + F.col("n_regionkey")).alias("region_id"), "year_id", "population")
    )


# The same with a hierarchy: detailed nations (all but each seventh) with nine tenths of their people, and region totals.
ESTIMATES = """estimates AS (
  SELECT location_id, region_id AS parent_id, region_id, year_id, 0.9 * population AS population, 3 AS level, 1 AS most_detailed FROM series WHERE location_id % 7 <> 0
  UNION ALL SELECT region_id, 999, region_id, year_id, sum(population), 2, 0 FROM series GROUP BY region_id, year_id)"""


def estimates(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf)
    low = s.filter("location_id % 7 <> 0").select(
        "location_id", F.col("region_id").alias("parent_id"), "region_id", "year_id", (0.9 * F.col("population")).alias("population"), F.lit(3).alias("level"), F.lit(1).alias("most_detailed")
    )
    high = s.groupBy("region_id", "year_id").agg(F.sum("population").alias("population")).select(
        F.col("region_id").alias("location_id"), F.lit(999).alias("parent_id"), "region_id", "year_id", "population", F.lit(2).alias("level"), F.lit(0).alias("most_detailed")
    )
    return named(low.unionByName(high))


def named(df: DataFrame) -> DataFrame:
    code = F.concat(F.lit("L"), F.col("location_id").cast("string"))
    return df.withColumns({"location_name": code, "location_code": code})


# Pixels with a location: lines with their customer's nation.
PIXELS = """pixels AS (
  SELECT c_nationkey AS location_id, l_extendedprice * (1 - l_discount) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
TARGETS = "targets AS (SELECT c_nationkey AS location_id, sum(c_acctbal) AS population FROM customer GROUP BY 1)"


def priced_pixels(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("location_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("location_id", "value")


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("location_id")).agg(F.sum("c_acctbal").alias("population"))


# Intersections: supplier as unit, line number as tile, part as pixel.
INTERSECTIONS = """isect AS (
  SELECT l_suppkey AS admin_id, l_linenumber AS tile_key, l_partkey AS pixel_id, sum(l_quantity) AS isection_area, max(l_discount) AS pixel_value FROM lineitem GROUP BY 1, 2, 3),
rows AS (
  SELECT i.*, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS admin_population, 100000.0 AS admin_area, 100.0 AS pixel_area
  FROM isect i JOIN supplier ON s_suppkey = admin_id)"""


def intersections(spark: SparkSession, sf: str, tile: str = "l_linenumber") -> DataFrame:
    money = F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal"))
    units = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("admin_id"), money.alias("admin_population"))
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("admin_id"), F.expr(tile).alias("tile_key"), F.col("l_partkey").alias("pixel_id"))
        .agg(F.sum("l_quantity").alias("isection_area"), F.max("l_discount").alias("pixel_value"))
        .join(units, "admin_id")
        .withColumns({"admin_area": F.lit(100000.0), "pixel_area": F.lit(100.0), "denominator": F.lit("built")})
    )


# Rasters: each vector is a tile of 8 by 8 absolute values, in thousandths to keep sums exact.
RASTER = """raster AS (
  SELECT vec_id, label, CAST((k - 1) // 8 AS INT) AS "row", CAST((k - 1) % 8 AS INT) AS col, round(abs(embedding[k]::double), 3) AS value
  FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS k FROM embeddings))"""


def raster(spark: SparkSession, sf: str) -> DataFrame:
    """(block_key, vec_id, label, row, col, value)."""
    cells = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v"))
    return cells.select(
        F.col("vec_id").cast("string").alias("block_key"), "vec_id", "label",
        F.floor(F.col("k") / 8).cast("int").alias("row"), (F.col("k") % 8).cast("int").alias("col"), F.round(F.abs(F.col("v").cast("double")), 3).alias("value"),
    )


#: Polygons on part size (x) and price (y): identifier, ordinal and corners.
SHAPES = {
    1: (1, [(0, 900), (20, 900), (20, 1200), (0, 1200)]),
    2: (2, [(10, 1000), (40, 1000), (25, 1600)]),
    3: (3, [(5, 950), (15, 950), (15, 1050), (10, 1000), (5, 1050)]),
    4: (4, [(60, 100), (70, 100), (70, 200)]),
}
POINTS = "pts AS (SELECT p_partkey, p_size + 0.5 AS x, p_retailprice + 0.013 AS y FROM part)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") + 0.5).alias("x"), (F.col("p_retailprice") + 0.013).alias("y"))


def shapes(spark: SparkSession, boxes: bool = False) -> DataFrame:
    import numpy as np

    from popquilt.operators import geometry as G

    rows = []
    for k, (ordinal, corners) in SHAPES.items():
        parts = [[np.array(corners, float)]]
        rows.append((k, ordinal, bytearray(G.write_wkb(G.box(*G.bounds(parts)) if boxes else parts)), *map(float, G.bounds(parts))))
    return spark.createDataFrame(rows, "shape_id int, ordinal int, geometry binary, minx double, miny double, maxx double, maxy double")


def edges_sql() -> str:
    """The shapes' edges as a table for ray casting in SQL."""
    rows = [
        f"({k}, {o}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)"
        for k, (o, c) in SHAPES.items()
        for a, b in zip(c, c[1:] + c[:1])
    ]
    return f"edges(shape_id, ordinal, ax, ay, bx, by_) AS (VALUES {', '.join(rows)})"


def part_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """A polygon for each part: a box, a triangle, or a box with a notch. Rows are dealt out while they are two numbers, as a file of parts may be one task."""
    from popquilt.operators import geometry as G
    from popquilt.operators import polygons as PG

    k, s = F.col("p_partkey"), F.col("p_size")
    x, y, w, h = (k % 97) * 1.5, s * 2.0 + k % 7, 5.0 + s % 11, 4.0 + k % 13

    def ring(*points):
        return F.array(*(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in points))

    box, triangle = ring((x, y), (x + w, y), (x + w, y + h), (x, y + h)), ring((x, y), (x + w, y), (x + w / 2, y + h))
    notched = ring((x, y), (x + w, y), (x + w, y + h), (x + w / 2, y + h / 4), (x, y + h))
    rings = PG.spread(table(spark, sf, "part").select("p_partkey", "p_size")).select(k.alias("shape_id"), F.when(k % 3 == 0, box).when(k % 3 == 1, triangle).otherwise(notched).alias("ring"))
    return rings.select("shape_id", G.st_polygon("ring").alias("geometry"))


#: The same polygons' edges.
PART_EDGES = """pc AS (SELECT p_partkey AS shape_id, p_partkey % 97 * 1.5::double AS x, p_size * 2.0::double + p_partkey % 7 AS y, 5.0::double + p_size % 11 AS w, 4.0::double + p_partkey % 13 AS h FROM part),
pr AS (SELECT *, CASE shape_id % 3 WHEN 0 THEN [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] WHEN 1 THEN [[x, y], [x + w, y], [x + w / 2, y + h]]
  ELSE [[x, y], [x + w, y], [x + w, y + h], [x + w / 2, y + h / 4], [x, y + h]] END AS ring FROM pc),
pn AS (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM pr),
edges AS (SELECT shape_id, ring[i][1] AS ax, ring[i][2] AS ay, ring[i % len(ring) + 1][1] AS bx, ring[i % len(ring) + 1][2] AS by_ FROM pn),
bounds AS (SELECT shape_id, min(ax) AS minx, max(ax) AS maxx, min(ay) AS miny, max(ay) AS maxy FROM edges GROUP BY 1)"""

INSIDE = """inside AS (
  SELECT p_partkey, x, y, shape_id, ordinal FROM pts JOIN edges ON true
  GROUP BY ALL HAVING sum(CASE WHEN (ay > y) <> (by_ > y) AND ay <> by_ AND x < (bx - ax) * (y - ay) / nullif(by_ - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1)"""
