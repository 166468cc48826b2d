"""Operators on small fixtures with known results, and invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from popquilt.functions import constants as C
from popquilt.functions import keys as K
from popquilt.functions import projections as P
from popquilt.functions import semantics as S
from popquilt.functions.metrics import METRICS
from popquilt.functions.transforms import TARGETS, TRANSFORMS, targets
from popquilt.operators import allocate, census, model, rake, ranks, raster, spatial_join, timeaxis
from popquilt.operators import geometry as G
from popquilt.operators import raking_population as R

NAN, INF = float("nan"), float("inf")


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


# Missing values


def test_division(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 4.0), (None, 0.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(S.safe_divide("a", "b")).collect()] == [0.0, INF, -INF, 0.25, None, None]
    assert [r[0] for r in df.select(S.ratio("a", "b")).collect()] == [None, None, None, 0.25, None, None]


def test_missing_values(spark):
    x = F.col("x")
    assert column(spark, [NAN, None, 2.0], S.nan_to_null("x")) == [None, None, 2.0]
    assert column(spark, [-1.0, None, 2.0], S.clip_low("x")) == [0.0, None, 2.0]
    assert column(spark, [-1.0, None, 9.0], S.clamp("x", 0.0, 5.0)) == [0.0, None, 5.0]
    assert column(spark, [0.0, 1.0, -1.0, None], S.natural_log("x")) == [-INF, 0.0, None, None]
    assert column(spark, [0.009, 0.01, None], S.suppress_noise("x")) == [0.0, 0.01, None]
    assert column(spark, [INF, NAN, 1.0, None], S.finite_or("x")) == [0.0, 0.0, 1.0, None]
    assert column(spark, [1234.0, 0.012345, 0.0], S.significant("x", 2)) == pytest.approx([1200.0, 0.012, 0.0])
    assert column(spark, [1.29, -0.01], S.precise_floor("x", 1)) == [1.2, -0.1]
    assert column(spark, [0.0, 1.0, 1.5, 3.0, 3.1, None], S.cut("x", (0, 1, 2, 3))) == [0, 0, 1, 2, None, None]
    df = spark.createDataFrame([(1, None), (1, NAN), (2, 3.0), (2, NAN)], "k int, x double")
    assert {r["k"]: r["t"] for r in df.groupBy("k").agg(S.total("x").alias("t")).collect()} == {1: 0.0, 2: 3.0}
    assert S.clean(df).filter("x is null").count() == 3
    assert df.withColumn("o", -x).groupBy("k").agg(S.first_by("x", "k").alias("f")).count() == 2


# Keys and constants


def test_keys(spark):
    df = spark.createDataFrame([("2020q3", "B-0010X-0007Y", "AB_C_2011", "2025_06_21.007")], "t string, b string, n string, v string")
    r = df.select(K.time_value(F.col("t")), K.block_x(F.col("b")), K.block_y(F.col("b")), K.group_key(F.col("b")), K.iso3_of(F.col("n")), K.census_year_of(F.col("n")), K.version_number(F.col("v"))).first()
    assert tuple(r) == (2020.5, 10, 7, "G-0001X-0000Y", "AB_C", "2011", 7)
    assert df.select(K.block_key(F.lit(10), F.lit(7))).first()[0] == "B-0010X-0007Y"


def test_constants():
    assert [len(v.time_points) for v in C.BUILT_VERSIONS.values()] == [11, 15, 15, 17]
    assert len(C.DENOMINATORS) == 16 and len(C.ALL_TIME_POINTS) == 64 and len(C.UPSAMPLE) == 13
    with pytest.raises(ValueError):
        C.Crs("x", "cea", 0, (1, 0, 0, 1), "+proj=cea")


def test_projection_bounds(spark):
    df = spark.createDataFrame([(180.0, 90.0), (-180.0, -90.0), (0.0, 0.0), (90.0, 45.0)], "lon double, lat double")
    lon, lat = F.col("lon"), F.col("lat")
    cea = df.select(*P.equal_area(lon, lat)).collect()
    assert tuple(cea[0]) == pytest.approx((20037508.34, 6363885.33), abs=0.01) and tuple(cea[1]) == pytest.approx((-20037508.34, -6363885.33), abs=0.01)
    moll = df.select(*P.mollweide(lon, lat)).collect()
    assert moll[0][1] == pytest.approx(9020047.85, abs=0.01)
    assert df.select(P.mollweide(F.lit(180.0), F.lit(0.0))[0]).first()[0] == pytest.approx(18040095.70, abs=0.01)
    back = df.select(P.longitude(P.equal_area(lon, lat)[0]), P.latitude(P.equal_area(lon, lat)[1])).collect()
    assert tuple(back[3]) == pytest.approx((90.0, 45.0), abs=1e-6)
    with pytest.raises(ValueError):
        P.project("nope", lon, lat)


# Raking population


def hierarchy_rows():
    return [(1, "world", "W", None, None, 0, 0), (10, "r1", "R1", 1, 10, 2, 0), (11, "a", "AAA", 10, 10, 3, 0), (12, "b", "BBB", 10, 10, 3, 1), (111, "a1", "AAA_1", 11, 10, 4, 1), (112, "a2", "AAA_2", 11, 10, 4, 1), (20, "none", "NON", 1, None, 3, 1)]


def test_raking_population_chain(spark):
    h = spark.createDataFrame(hierarchy_rows(), "location_id int, location_name string, location_code string, parent_id int, region_id int, level int, most_detailed int")
    pop = {1: 200.0, 10: 130.0, 11: 60.0, 12: 40.0, 111: 20.0, 112: 40.0, 20: 5.0}
    primary = spark.createDataFrame([(k, 2020, v) for k, v in pop.items()], "location_id int, year_id int, population double").join(h, "location_id")
    wpp = spark.createDataFrame([("AAA", 2020, 80.0), ("BBB", 2020, 50.0), ("CCC", 2020, 12.0), ("DDD", 2020, 6.0), ("ZZZ", 2020, 1.0)], "iso3 string, year_id int, population double")
    extra = [(31, "c", 10, "CCC", "wpp"), (32, "d", 10, "DDD", "wpp"), (33, "e", -1, "EEE", "zero_population"), (34, "f", -1, "FFF", "unmodeled")]
    supplement = spark.createDataFrame(extra, "location_id int, location_name string, region_id int, location_code string, category string")
    nothing = spark.createDataFrame([], "location_id int")
    got = {r["location_id"]: r for r in R.build(wpp, primary, h, supplement, nothing).collect()}
    assert set(got) >= {12, 111, 112, 20, 31, 32}
    # the region's 130 less 100 detailed are shared 12 to 6
    assert got[31]["population"] == pytest.approx(20.0) and got[32]["population"] == pytest.approx(10.0)
    # subnationals get their country's series by share: 80 * 20 / 60
    assert got[111]["wpp_population"] == pytest.approx(80 / 3) and got[12]["wpp_population"] == 50.0
    assert got[20]["region_id"] == C.NO_REGION and got[20]["wpp_population"] is None
    merged = R.prepare_series(primary, spark.createDataFrame([(11,)], "location_id int")).collect()
    assert {r["location_id"] for r in merged if r["most_detailed"] == 1} == {11, 12, 20}


def test_merging_keeps_missing(spark):
    wpp = spark.createDataFrame([("CHN", 1, 5.0), ("HKG", 1, 2.0), ("MAC", 1, None), ("SRB", 1, None), ("XKX", 1, None)], "iso3 string, year_id int, population double")
    assert {r["iso3"]: r["population"] for r in R.merge_countries(wpp).collect()} == {"CHN": 7.0, "SRB": None}


def test_lost_regions_stop_the_job(spark):
    wpp = spark.createDataFrame([(5, 70, 2020, 10.0, 1.0, "n", "c")], "location_id int, region_id int, year_id int, population double, scalar double, location_name string, location_code string")
    estimates = spark.createDataFrame([(10, 1, 10, 2020, 9.0, 2, 0, "r", "R")], "location_id int, parent_id int, region_id int, year_id int, population double, level int, most_detailed int, location_name string, location_code string")
    with pytest.raises(Exception, match="no residual population of region 70"):
        R.missing_populations(wpp, estimates).collect()


def test_climb_ends_in_cycles(spark):
    parents = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, None)], "location_id int, parent_id int")
    goals = spark.createDataFrame([(4,)], "location_id int")
    found = R.nearest_ancestor(spark.createDataFrame([(1,), (3,), (4,), (9,)], "location_id int"), parents, goals)
    assert {r["location_id"]: r["ancestor_id"] for r in found.collect()} == {1: None, 3: 4, 4: 4, 9: None}


def test_validation_raises(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "location_id int") for v in ([1, 2], [2, 3]))
    with pytest.raises(ValueError, match="1 has no shape"):
        R.validate(a, b)
    R.validate(a, a)


# Time


def test_interpolation_and_clamps(spark):
    values = spark.createDataFrame([("b", 1, "2000q1", 1.0), ("b", 1, "2005q1", 2.0), ("b", 2, "2000q1", 0.004), ("b", 2, "2005q1", 0.012)], "f string, k int, time_point string, value double")
    wanted = spark.createDataFrame([("b", t) for t in ("1999q1", "2000q1", "2002q3", "2005q1", "2010q1")], "f string, time_point string")
    got = {(r["k"], r["time_point"]): r["value"] for r in timeaxis.interpolate(values, wanted, ["f"], ["k"]).collect()}
    assert got[1, "2002q3"] == pytest.approx(1.5) and got[1, "2005q1"] == 2.0 and got[1, "2010q1"] == 2.0 and got[2, "2002q3"] == 0.0
    assert (1, "1999q1") not in got
    years = spark.createDataFrame([(7, 2023, 10.0), (7, 2024, 20.0)], "location_id int, year_id int, population double")
    t = spark.createDataFrame([("2023q1",), ("2023q3",), ("2024q4",), ("2030q2",)], "time_point string")
    assert {r["time_point"]: r["population"] for r in timeaxis.quarterly(years, t).collect()} == {"2023q1": 10.0, "2023q3": 15.0, "2024q4": 20.0, "2030q2": 20.0}


# Rasters


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 5), st.sampled_from(["uniform", "gaussian"]), st.integers(0, 10**6))
def test_convolution_is_direct_summation(radius, kind, seed):
    w = raster.kernel(1, radius, kind)
    assert w.sum() == pytest.approx(1)
    a = np.random.default_rng(seed).random((9, 12))
    r, direct = len(w) // 2, np.zeros_like(a)
    for i in range(9):
        for j in range(12):
            for dy in range(-r, r + 1):
                for dx in range(-r, r + 1):
                    if 0 <= i - dy < 9 and 0 <= j - dx < 12:
                        direct[i, j] += w[dy + r, dx + r] * a[i - dy, j - dx]
    assert np.allclose(raster.convolve(a, w), direct, atol=1e-12)


def test_kernel_sizes():
    assert (raster.kernel(100, 100) > 0).sum() == 1 and (raster.kernel(100, 200) > 0).sum() == 9
    with pytest.raises(ValueError):
        raster.kernel(1, 1, "box")


def test_tiles_and_pixels(spark):
    rows = [("b", 0, 0, 2, 2, [0.0, 10.0, 100.0, -10.0], -1.0, [1.0, NAN, -1.0, 4.0]), ("b", 0, 1, 2, 2, [0.0, 10.0, 100.0, -10.0], -1.0, [5.0, 6.0, 7.0, 8.0])]
    tiles = spark.createDataFrame(rows, "block_key string, chunk_row int, chunk_col int, height int, width int, transform array<double>, nodata double, data array<float>")
    long = raster.pixels(tiles)
    got = {(r["row"], r["col"]): (r["x"], r["y"], r["value"]) for r in long.collect()}
    assert got[0, 0] == (5.0, 95.0, 1.0) and got[0, 1][2] is None and got[1, 0][2] is None and got[1, 3] == (35.0, 85.0, 8.0)
    back = {r["chunk_col"]: r["data"] for r in raster.to_tiles(long, 2, 2).collect()}
    assert back == {0: [1.0, None, None, 4.0], 1: [5.0, 6.0, 7.0, 8.0]}
    total = lambda df: df.agg(F.sum("value")).first()[0]
    assert total(raster.resample(long, 2, "sum")) == total(long) == 31.0
    assert total(raster.warp(long, F.col("x"), F.col("y"), (0.0, 0.0, 100.0, 100.0), 30.0, "sum")) == 31.0
    with pytest.raises(ValueError):
        raster.resample(long, 2, "mode")


def test_whole_tiles_take_seconds(spark):
    import time

    n = 512
    long = spark.range(n * n).filter("id % 7 <> 3").select(F.lit("b").alias("block_key"), (F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    raster.to_tiles(long.filter("row < 4"), 4, n).collect()
    began = time.time()
    (tile,) = raster.to_tiles(long, n, n).collect()
    assert time.time() - began < 5
    assert tile["data"] == [None if k % 7 == 3 else float(k) for k in range(n * n)]
    twice = spark.createDataFrame([("b", 0, 0, 1.0), ("b", 0, 0, 3.0), ("b", 0, 0, None), ("b", 1, 0, None)], "block_key string, row int, col int, value double")
    assert raster.to_tiles(twice, 2, 2).first()["data"] == [3.0, None, None, None] and raster.to_tiles(twice, 2, 2, fill=0.0).first()["data"] == [3.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(("radius", "kind"), [(2, "uniform"), (3, "gaussian"), (11, "gaussian")])
def test_averages_see_the_next_block(spark, radius, kind):
    """Two by three blocks, of which one is absent, against the convolution of the whole map; the kernel may be wider than a block."""
    rng = np.random.default_rng(radius)
    whole = rng.uniform(0, 9, (16, 24))
    whole[8:, 8:16] = 0
    whole[3, 9] = np.nan
    at = [(y, x) for y in range(2) for x in range(3) if (y, x) != (1, 1)]
    rows = [(f"b{y}{x}", 0, 0, 8, 8, [100.0 * x * 8, 100.0, -100.0 * y * 8, -100.0], whole[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].ravel().tolist()) for y, x in at]
    tiles = spark.createDataFrame(rows, "block_key string, chunk_row int, chunk_col int, height int, width int, transform array<double>, data array<double>")
    w = raster.kernel(100, radius * 100, kind)
    want = raster.convolve(np.nan_to_num(whole), w)
    got = {r["block_key"]: np.array(r["data"]).reshape(8, 8) for r in raster.average_with_neighbours(tiles, 100, radius * 100, kind).collect()}
    assert len(got) == 5
    for y, x in at:
        own = want[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8]
        own = own - own.min()
        own[own < C.AVERAGE_NOISE] = 0
        assert np.allclose(got[f"b{y}{x}"], own, atol=1e-5)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(allow_infinity=True), st.sampled_from([0.0, 1.0, 1e300, -1e300, 5e-324])), max_size=60))
def test_ranks_are_those_of_sorting(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    assert ranks.values_at(df, "x", list(range(0, len(known), 3))) == known[::3] if known else ranks.percentiles(df, "x", [0.5]) == [None]
    with pytest.raises(ValueError):
        ranks.values_at(df, "x", [len(known)])


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=3001), np.repeat(0.25, 500), rng.normal(size=50) * 1e9])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    shares = [0, 0.01, 0.25, 0.5, 0.9, 1]
    assert ranks.percentiles(df, "x", shares) == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)


def test_gap_fill_takes_the_nearest():
    a = np.full((5, 5), np.nan)
    a[0, 0], a[4, 4] = 7, 9
    out = raster.nearest_fill(a, 3)
    assert out[1, 1] == 7 and out[3, 3] == 9 and np.isnan(out[4, 0])


# Geometry

STAR = [[np.array([[0, 3], [1, 1], [3, 0], [1, -1], [0, -3], [-1, -1], [-3, 0], [-1, 1]], float)]]
HOLED = [[np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float), np.array([[1, 1], [2, 1], [2, 2], [1, 2]], float)], [np.array([[6, 0], [7, 0], [7, 1]], float)]]


def test_wkb_round_trip():
    for parts in (STAR, HOLED):
        again = G.read_wkb(G.write_wkb(parts))
        assert all((a == b).all() for x, y in zip(parts, again) for a, b in zip(x, y)) and G.area(again) == G.area(parts)
    big = bytes([0]) + (3).to_bytes(4, "big") + (1).to_bytes(4, "big") + (4).to_bytes(4, "big") + np.array([[0, 0], [2, 0], [0, 2], [0, 0]], ">f8").tobytes()
    assert G.area(G.read_wkb(big)) == 2
    with pytest.raises(ValueError):
        G.read_wkb(bytes([1, 1, 0, 0, 0, 0, 0, 0, 0]))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_clipping_keeps_area(seed):
    rng = np.random.default_rng(seed)
    angles = (np.arange(9) + rng.random(9)) * 2 * math.pi / 9  # gaps under a half turn: the ring does not cross itself
    ring = np.stack([np.cos(angles), np.sin(angles)], 1) * rng.uniform(0.5, 4, 9)[:, None]
    parts = [[ring]]
    cells = sum(G.area(G.clip(parts, x, y, x + 1, y + 1)) for x in range(-4, 4) for y in range(-4, 4))
    assert cells == pytest.approx(G.area(parts), abs=1e-9)


def test_predicates():
    x, y = np.array([0.0, 2.5, 2.0, 1.5]), np.array([0.0, 2.5, 0.1, 1.5])
    assert G.contains(STAR, x, y).tolist() == [True, False, True, False]
    assert G.contains(HOLED, np.array([1.5, 0.5]), np.array([1.5, 0.5])).tolist() == [False, True]
    left, right = G.box(0, 0, 1, 1), G.box(1, 0, 2, 1)
    edge = (np.array([1.0]), np.array([0.5]))
    assert G.contains(left, *edge)[0] != G.contains(right, *edge)[0]
    assert G.meets_box(STAR, -0.1, -0.1, 0.1, 0.1) and not G.meets_box(STAR, 2, 2, 3, 3) and G.distance_to_box(HOLED, 9, 0, 10, 1) == pytest.approx(2)
    assert len(G.convex_hull(STAR[0][0])) == 4
    assert G.bounds_of(None) is None and G.bounds_of(STAR) == (-3, -3, 3, 3) and G.bounds_of((0, 1, 2, 3)) == (0, 1, 2, 3)
    with pytest.raises(TypeError):
        G.bounds_of(3)


def test_spatial_columns(spark):
    df = spark.createDataFrame([(1, bytearray(G.write_wkb(HOLED))), (2, None)], "k int, geometry binary")
    r = G.with_bounds(df).withColumns({"a": G.st_area("geometry"), "h": G.st_area(G.st_hull("geometry")), "n": F.size(G.st_parts("geometry"))}).orderBy("k").collect()
    assert r[0]["a"] == 15.5 and r[0]["n"] == 2 and r[0]["maxx"] == 7 and r[1]["a"] is None
    cut = spatial_join.overlay(G.with_bounds(df.filter("k = 1")), 1.0)
    assert cut.agg(F.sum("isection_area")).first()[0] == pytest.approx(15.5)
    clipped = df.select(G.st_area(G.st_clip("geometry", F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))))
    assert clipped.first()[0] == 3.0


def random_polygon(rng, n=40):
    """A star-shaped ring with a hole, and a second part beside it."""
    angles = (np.arange(n) + rng.random(n)) * 2 * math.pi / n
    unit = np.stack([np.cos(angles), np.sin(angles)], 1)
    ring = unit * rng.uniform(2, 7, n)[:, None] + rng.uniform(-2, 2, 2)
    hole = (unit * 0.9)[::-1] + ring.mean(0)
    return [[ring, hole], [np.array([[9, -3], [11.5, -3], [9, 2.25]], float)]]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.7, 1.0, 3.0]))
def test_cells_decide_like_the_whole_polygon(seed, size):
    rng = np.random.default_rng(seed)
    parts = random_polygon(rng)
    edges = G.edges_of(parts)
    x, y = rng.uniform(-10, 12, (2, 3000))
    got = np.zeros(3000, dtype=bool)
    for cx, cy, own in G.cells_of(edges, size, math.floor(-10 / size), math.floor(12 / size)):
        mine = (np.floor(x / size) == cx) & (np.floor(y / size) == cy)
        got[mine] = True if own is None else G.inside_edges(own, x[mine], y[mine])
    assert (got == G.contains(parts, x, y)).all() and got.any()
    assert sum(own is None for *_, own in G.cells_of(edges, 0.1, -100, 120)) > 500


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1 << 20, 30]))
def test_coverage_is_clipping(seed, most):
    parts = random_polygon(np.random.default_rng(seed))
    parts[0] = parts[0][:1]
    col, row, areas = G.coverage(G.edges_of(parts), 0.8, 0.3, -0.1, -15, 18, most)
    for c, r, a in zip(col, row, areas):
        x, y = 0.3 + 0.8 * c, -0.1 + 0.8 * r
        assert a == pytest.approx(G.area(G.clip(parts, x, y, x + 0.8, y + 0.8)), abs=1e-9)
    assert areas.sum() == pytest.approx(G.area(parts), abs=1e-6) and len(set(zip(col, row))) == len(col)


def test_many_vertices_over_many_cells_are_fast(spark):
    import time

    angles = np.arange(500) * 2 * math.pi / 500
    ring = np.stack([np.cos(angles), np.sin(angles)], 1) * (40 + 2 * np.cos(17 * angles))[:, None]
    shape = G.with_bounds(spark.createDataFrame([(1, bytearray(G.write_wkb([[ring]])))], "shape_id int, geometry binary"))
    points = spark.range(200 * 200).select(((F.col("id") % 200) - 99.5).alias("x"), (F.floor(F.col("id") / 200) - 99.5).alias("y"))
    spatial_join.points_in(points, shape, 8.0).count()
    began = time.time()
    assert spatial_join.overlay(shape, 1.0).count() > 5000
    inside = spatial_join.points_in(points, shape, 8.0).count()
    assert time.time() - began < 10
    x, y = np.meshgrid(np.arange(200) - 99.5, np.arange(200) - 99.5)
    assert inside == G.contains([[ring]], x, y).sum()


def test_points_on_shared_edges_are_in_one_polygon(spark):
    rows = [(k, bytearray(G.write_wkb(G.box(k, 0, k + 1, 1)))) for k in range(3)]
    shapes = G.with_bounds(spark.createDataFrame(rows, "k int, geometry binary"))
    pts = spark.createDataFrame([(float(x) / 2, 0.5, 1.0) for x in range(1, 6)], "x double, y double, value double")
    assert spatial_join.points_in(pts, shapes, 0.7).count() == 5
    assert sum(r["value"] for r in spatial_join.zonal_sum(pts, shapes, 0.7, ["k"]).collect()) == 5


def test_buffered_pairs(spark):
    shapes = G.with_bounds(spark.createDataFrame([(1, bytearray(G.write_wkb(STAR)))], "k int, geometry binary"))
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0), (2, 4.0, 0.0, 5.0, 1.0), (3, 3.0, 3.0, 4.0, 4.0)], "box_id int, bx0 double, by0 double, bx1 double, by1 double")
    assert {r["box_id"] for r in spatial_join.pairs(shapes, boxes, 2.0).collect()} == {1}
    assert {r["box_id"] for r in spatial_join.pairs(shapes, boxes, 2.0, 1.0).collect()} == {1, 2}


# Allocation and raking


def intersections(spark):
    rows = [("a", 10.0, 3.0, "t1", 1, 1.0, 1.0, 0.5), ("a", 10.0, 3.0, "t2", 2, 1.0, 0.5, 1.0), ("b", 4.0, 1.0, "t1", 1, 1.0, 0.5, 0.5), ("c", 6.0, 1.0, "t1", 3, 1.0, 1.0, 0.0), ("d", 0.0, 1.0, "t1", 4, 1.0, 1.0, 0.0), ("e", 0.0, 1.0, "t1", 5, 1.0, 1.0, 0.7)]
    df = spark.createDataFrame(rows, "admin_id string, admin_population double, admin_area double, tile_key string, pixel_id int, pixel_area double, isection_area double, pixel_value double")
    return df.withColumn("denominator", F.lit("d"))


def test_allocation(spark):
    done = allocate.allocate(intersections(spark))
    got = {(r["admin_id"], r["pixel_id"]): r for r in done.collect()}
    assert got["a", 1]["isection_population"] == 5 and got["a", 1]["pixel_population"] == 9 and got["a", 1]["admin_multi_tile"]
    assert got["c", 3]["admin_occupancy_rate"] == -1 and got["c", 3]["pixel_log_occupancy_rate"] == -1
    assert got["d", 4]["admin_occupancy_rate"] == 0 and got["e", 5]["pixel_occupancy_rate"] == 0
    sums = done.filter("admin_built > 0").groupBy("admin_id").agg(F.sum("isection_population").alias("s"), F.max("admin_population").alias("p")).collect()
    assert all(r["s"] == pytest.approx(r["p"]) for r in sums)
    assert [r["units"] for r in allocate.coverage(done, 0.5).collect()] == [5, 1, 3, 2, 1, 1]
    grid = allocate.densify(done, spark.createDataFrame([("t1", 7)], "tile_key string, n_pixels int"), "pixel_population")
    assert {r["pixel_id"]: r["pixel_population"] for r in grid.collect()} == {0: 0, 1: 9, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}
    assert allocate.one_per_admin(done).count() == 5


def test_raked_sums_are_the_targets(spark):
    pixels = spark.createDataFrame([("b1", 1, 2.0), ("b1", 1, 3.0), ("b2", 1, 5.0), ("b2", 2, 0.0), ("b2", None, 9.0)], "block_key string, location_id int, value double")
    targets_ = spark.createDataFrame([(1, 40.0), (2, 7.0), (3, 1.0)], "location_id int, population double")
    f = {r["location_id"]: r["raking_factor"] for r in rake.factors(pixels, targets_).collect()}
    assert f == {1: 4.0, 2: None, 3: None}
    raked = rake.rake(pixels, rake.factors(pixels, targets_))
    assert raked.filter("location_id = 1").agg(F.sum("raked")).first()[0] == 40.0 and raked.filter("location_id is null").first()["raked"] is None


# Census


def test_census_checks(spark):
    shapes = spark.createDataFrame([("a",), ("b",)], "shape_id string")
    counts = spark.createDataFrame([("a", 1.0)], "shape_id string, n double")
    with pytest.raises(ValueError):
        census.join_counts(shapes, counts)
    assert census.join_counts(shapes, counts, check=False).count() == 1
    with pytest.raises(ValueError):
        census.align_measures({})
    assert "household_total" in census.align_measures({"population_total": spark.createDataFrame([("a", 1.0)], "shape_id string, value double")}).columns
    runs = spark.createDataFrame([("AAA", "2000"), ("BBB", "2001")], "iso3 string, year string")
    assert census.select_runs(runs, "aaa").count() == 1
    with pytest.raises(ValueError):
        census.select_runs(runs, "AAA", "2001")
    paths = spark.createDataFrame([("1,10",), ("10,100",), ("100",)], "p string")
    assert [r[0] for r in paths.select(census.under(F.col("p"), ["1"])).collect()] == [True, False, False]
    h = spark.createDataFrame([("AAA",), ("AAA_1",), ("BBB_1",)], "location_code string")
    assert census.country_locations(h, "AAA").count() == 1 and census.country_locations(h, "BBB").count() == 1
    share = census.heatmap(spark.createDataFrame([(0.5, 0.5), (30.0, 3.0)], "population_total double, area double"))
    assert share.agg(F.sum("share")).first()[0] == 1 and share.count() == 110
    assert census.pivoted(share, 10).count() == 11


# Model


def test_metrics_and_transforms(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 1.0)], "y double, p double")
    r = df.agg(*(f(F.col("y"), F.col("p")).alias(k) for k, f in METRICS.items())).first()
    assert r["mae"] == pytest.approx(5 / 3) and r["mse"] == pytest.approx(17 / 3) and r["r2"] == pytest.approx(1 - 17 / 8) and r["mape"] == pytest.approx((1 + 0 + 0.8) / 3)
    one = spark.createDataFrame([(0.7, 0.2)], "z double, b double")
    people = {k: one.select(targets(k, F.col("z"), F.col("b"))["population"]).first()[0] for k in TRANSFORMS}
    for kind in TRANSFORMS:  # a transform's own target is its output, and all targets agree on the people
        out = targets(kind, F.col("z"), F.col("b"))
        assert one.select(out[kind]).first()[0] == pytest.approx(0.7) and set(out) == set(TARGETS)
        dens = one.select(out["population_density"] * 1600.0).first()[0]
        assert dens == pytest.approx(people[kind])
    with pytest.raises(ValueError):
        targets("nope", F.col("z"), F.col("b"))


def test_splits_keep_their_tiles(spark):
    tiles = spark.range(2000).select(F.col("id").cast("string").alias("tile_key"))
    one = {r["tile_key"]: r["split"] for r in model.split(tiles, 3).collect()}
    few = {r["tile_key"]: r["split"] for r in model.split(tiles.limit(50), 3).collect()}
    assert all(one[k] == v for k, v in few.items())
    share = {s: sum(v == s for v in one.values()) / 2000 for s in model.TRAIN_NAMES}
    assert share["test"] == pytest.approx(0.2, abs=0.03) and share["validate"] == pytest.approx(0.064, abs=0.02)
    assert model.splits(tiles.limit(5)).count() == 50
    assert model.part(tiles, model.split(tiles, 3), "test").count() == sum(v == "test" for v in one.values())


def test_least_absolute_deviations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = 1.5 + 2 * x[:, 0] - 0.5 * x[:, 1] + np.where(np.arange(400) % 10 == 0, 50.0, 0.0)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    m = model.fit_least_absolute(df, "y", ["a", "b"])
    assert (m.intercept, m.weights["a"], m.weights["b"]) == pytest.approx((1.5, 2, -0.5), abs=1e-3)
    assert model.fit_least_absolute(spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "y double"), "y").intercept == 2.0
    with pytest.raises(ValueError):
        model.fit_least_absolute(df.limit(0), "y")
    with pytest.raises(ValueError):
        model.Specification("d", kind="forest")
    assert model.predict(spark.createDataFrame([(2.0,)], "built double"), model.Linear(math.log(3))).first()["population"] == pytest.approx(6)
