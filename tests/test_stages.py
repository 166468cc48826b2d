"""The stages end to end on a small world, and the catalog."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from popquilt import cli
from popquilt.functions.constants import BUILT_VERSIONS
from popquilt.operators import geometry as G
from popquilt.operators.model import Specification
from popquilt.plans import stages
from popquilt.sources import schemas
from popquilt.sources.catalog import Catalog

CELL, SIDE = 100.0, 8
TILE = "feature string, block_key string, chunk_row int, chunk_col int, height int, width int, transform array<double>, crs string, nodata double, data array<float>"
VERSION, TIME = "ghsl_r2023a", "2020q1"


def block(bx, by):
    return f"B-{bx:04}X-{by:04}Y"


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    """Two by two blocks of eight cells; two countries side by side, the first of two units."""
    cat = Catalog(spark, str(tmp_path_factory.mktemp("world")))
    cat.write_info("frame", {"cell": CELL, "crs": "equal_area"})
    span = CELL * SIDE
    index = [(f"T-{bx}-{by}-{h}", block(bx, by), bx * span + h * span / 2, -(by + 1) * span, bx * span + (h + 1) * span / 2, -by * span) for bx in range(2) for by in range(2) for h in range(2)]
    cat.write(spark.createDataFrame(index, f"tile_key string, block_key string, {schemas.BOUNDS}"), "tile_index", resolution="100")
    rng = np.random.default_rng(0)
    for k, t in enumerate(BUILT_VERSIONS[VERSION].time_points[-3:]):
        rows = []
        for bx in range(2):
            for by in range(2):
                place = [bx * span, CELL, -by * span, -CELL]
                for name, low, high in (("density", 0.1, 0.9), ("height", 2.0, 9.0), ("proportion_residential", 0.2, 0.8)):
                    rows.append((name, block(bx, by), 0, 0, SIDE, SIDE, place, "equal_area", -99.0, rng.uniform(low, high, SIDE * SIDE).tolist()))
        cat.write(spark.createDataFrame(rows, TILE), "tiles", resolution="100", provider=VERSION, time_point=t)
    units = [
        ("A", "AAA", 0, (0, -1600, 800, 0), 300.0), ("A1", "AAA", 1, (0, -800, 800, 0), 100.0), ("A2", "AAA", 1, (0, -1600, 800, -800), 200.0),
        ("B", "BBB", 0, (800, -1600, 1600, 0), 500.0), ("B1", "BBB", 1, (800, -1600, 1600, 0), 500.0),
    ]
    shapes = [(s, None, s, s.lower(), s, bytearray(G.write_wkb(G.box(*b))), i, lev) for s, i, lev, b, _ in units]
    made = spark.createDataFrame(shapes, "shape_id string, parent_id string, shape_name string, shape_name_simple string, path_to_top_parent string, geometry binary, iso3 string, admin_level int")
    cat.write(made.withColumns({"year": F.lit("2020"), "purpose": F.lit("training")}), "shapefiles")
    counts = [(s, i, p) for s, i, _, _, p in units]
    cat.write(spark.createDataFrame(counts, "shape_id string, iso3 string, value double").withColumns({"measure": F.lit("population_total"), "year": F.lit("2020")}), "census_counts")
    tree = [(1, "world", "W", None, None, 0, 0), (10, "r", "R", 1, 10, 2, 0), (11, "a", "AAA", 10, 10, 3, 1), (12, "b", "BBB", 10, 10, 3, 1)]
    cat.ingest({"primary": spark.createDataFrame(tree, schemas.HIERARCHY.replace("location_id", "loc_id"))}, "hierarchies", "source")
    people = [(k, y, p * (1 + (y - 2020) / 10)) for k, p in ((1, 900.0), (10, 900.0), (11, 330.0), (12, 570.0)) for y in (2020, 2021)]
    cat.write(spark.createDataFrame(people, schemas.ESTIMATES), "populations", source="primary")
    wpp = [(i, y, p) for i, p in (("AAA", 400.0), ("BBB", 600.0)) for y in (2020, 2021)]
    cat.write(spark.createDataFrame(wpp, schemas.WPP), "wpp", version="2024")
    cat.write(spark.createDataFrame([(77, "z", -1, "ZZZ", "unmodeled")], schemas.SUPPLEMENT), "raking_inputs", version="primary", measure="supplement")
    for source, keep in (("primary", [11]), ("fallback", [11, 12, 77])):
        b = {11: (0, -1600, 800, 0), 12: (800, -1600, 1600, 0), 77: (9000, 9000, 9100, 9100)}
        cat.write(spark.createDataFrame([(k, bytearray(G.write_wkb(G.box(*b[k])))) for k in keep], "location_id int, geometry binary"), "shapes", source=source)
    return cat


def pixel_total(cat, table, **keys):
    return stages.long_view(cat.read(table, **keys), CELL).agg(F.sum("value")).first()[0]


def test_stages_run_in_order(cat, spark):
    stages.census_data(cat)
    assert cat.read("census").count() == 5 and cat.deepest_level("AAA", "2020") == 1
    assert cat.census("AAA", "2020", bounds=(0, -700, 700, -100), admin_level=1).count() == 1
    stages.raking_data(cat)
    raking = {(r["location_id"], r["year_id"]): r for r in cat.read("raking_population", version="primary").collect()}
    assert raking[11, 2020]["population"] == 330 and raking[12, 2020]["wpp_population"] == 600
    assert cat.read("raking_shapes", version="primary").count() == 3
    stages.modeling_frame(cat, "100")
    assert cat.read("modeling_frame", resolution="100").count() == 8 and cat.read("validation_frame", resolution="100").filter("iso3 = 'AAA'").count() >= 2
    stages.features(cat, "100", VERSION)
    f = f"{VERSION}_density"
    assert cat.feature("100", f, TIME).count() == 4 and cat.feature("100", f, "2022q1").count() == 4
    a, b, mid = (stages.long_view(cat.feature("100", f, t), CELL).orderBy("block_key", "row", "col").toPandas()["value"] for t in ("2020q1", "2025q1", "2021q1"))
    assert np.allclose(mid, 0.8 * a + 0.2 * b, atol=1e-5)
    logged = stages.long_view(cat.feature("100", f"log_{f}", TIME), CELL).orderBy("block_key", "row", "col").toPandas()["value"]
    assert np.allclose(logged, np.log1p(a), atol=1e-5)
    stages.averages(cat, "100", f, TIME, [300.0])
    assert cat.feature("100", f"{f}_300m", TIME).count() == 4

    stages.training_data(cat, "100", TIME, [f, f"{VERSION}_volume"], {"AAA": "2020", "BBB": "2020"})
    people = cat.read("people_per_structure", resolution="100")
    sums = {r["admin_id"]: r["s"] for r in people.filter(F.col("denominator") == f).groupBy("admin_id").agg(F.sum("isection_population").alias("s")).collect()}
    assert sums == pytest.approx({"A1": 100, "A2": 200, "B1": 500})
    weights = {r["admin_id"]: r["w"] for r in cat.read("pixel_area_weights", resolution="100").groupBy("admin_id").agg(F.sum("weight").alias("w")).collect()}
    assert weights == pytest.approx({"A1": 1, "A2": 1, "B1": 1})

    # units of the test world span tiles, so the model is written by hand
    from popquilt.operators.model import Linear

    version = cat.next_version("100", date(2025, 6, 21))
    assert version == "2025_06_21.001"
    cat.write_specification(Specification(f, "100", version=version))
    cat.write_model(Linear(0.5), "100", version)
    assert cat.next_version("100", date(2025, 6, 21)) == "2025_06_21.002" and cat.specification("100", version).denominator == f and cat.model("100", version).intercept == 0.5
    stages.inference(cat, "100", version, [TIME])
    assert pixel_total(cat, "raw_predictions", resolution="100", version=version) == pytest.approx(float(np.exp(0.5) * a.sum()), rel=1e-5)
    stages.inference(cat, "100", version, [TIME])
    assert cat.read("raw_predictions", resolution="100", version=version).count() == 4

    copy = "2025_06_21.002"
    cat.copy_version("100", copy, version)
    cat.copy_version("100", copy, version)
    assert cat.origin("100", copy) == version and cat.raw_predictions("100", copy, TIME).count() == 4
    stages.raking_factors(cat, "100", copy, [TIME, "2020q3"])
    assert cat.read("label_rasters", resolution="100", raking_version="primary").count() == 4  # once for both time points
    stages.rake(cat, "100", copy, [TIME])
    assert pixel_total(cat, "raked_predictions", resolution="100", version=copy, time_point=TIME) == pytest.approx(900, rel=1e-4)
    half = cat.raking_factors("100", copy, "2020q3").filter("location_id = 11").first()
    assert half["true_pop"] == pytest.approx(330 * 1.05)
    assert {r["group_key"] for r in stages.mosaic(cat, "100", copy, TIME).collect()} == {"G-0000X-0000Y"}
    stages.upsample(cat, "100", copy, TIME, "world_cylindrical_1000")
    up = cat.read("compiled_predictions", resolution="100", version=copy, spec="world_cylindrical_1000")
    assert up.agg(F.sum("value")).first()[0] == pytest.approx(900, rel=1e-4) and up.count() == 9
    stages.upsample(cat, "100", copy, TIME, "wgs84_0p01")
    assert cat.read("compiled_predictions", spec="wgs84_0p01").agg(F.sum("value")).first()[0] == pytest.approx(900, rel=1e-4)
    stages.metrics(cat, "100", [copy], TIME)
    assert sum(r["population"] for r in cat.read("raw_validation", resolution="100", version=copy).collect()) == pytest.approx(900, rel=1e-5)
    rasters = cat.read("training_rasters", resolution="100", measure=f"population_{f}")
    assert rasters.select(F.sum(F.aggregate("data", F.lit(0.0), lambda a, v: a + v))).first()[0] == pytest.approx(800, rel=1e-4)
    stages.metrics(cat, "100", [copy], TIME, raked=False)
    found = {r["shape_id"]: r["population"] for r in cat.read("raw_validation", resolution="100", version=copy).collect()}
    assert set(found) == {"A1", "A2", "B1"} and sum(found.values()) == pytest.approx(float(np.exp(0.5) * a.sum()), rel=1e-5)


def test_training_on_units_of_one_tile(cat, spark):
    rows = [(f"u{k}", "d", f"T-0-0-{k % 2}", float(k), float(k), False) for k in range(1, 30)]
    made = spark.createDataFrame(rows, "admin_id string, denominator string, tile_key string, admin_log_occupancy_rate double, admin_occupancy_rate double, admin_multi_tile boolean")
    cat.write(made, "people_per_structure_summary", resolution="40")
    cat.write(spark.createDataFrame([("x", "2020q1", "t")], "admin_id string, time_point string, tile_key string"), "people_per_structure", resolution="40")
    frame = spark.createDataFrame([("T-0-0-0", "b", "train"), ("T-0-0-1", "b", "test")], "tile_key string, block_key string, split_0 string")
    cat.write(frame, "modeling_frame", resolution="40")
    fitted = stages.train(cat, Specification("d", "40", version="v.001"))
    assert fitted.intercept == 15.0 and cat.model("40", "v.001").intercept == 15.0
    found = {r["split"]: r for r in cat.read("model_scores", resolution="40", version="v.001").collect()}
    assert set(found) == {"train", "test"} and {r["target"] for r in found.values()} == {"log_occupancy_rate"}
    assert found["train"]["rows"] == 14 and found["train"]["mae"] == np.mean([abs(k - 15) for k in range(2, 30, 2)])
    assert found["test"]["rows"] == 15 and found["test"]["rmse"] == pytest.approx(np.sqrt(np.mean([(k - 15) ** 2 for k in range(1, 30, 2)])))


def test_fine_raking(cat, spark):
    """A mask in Mercator about 150 degrees, over the world of the fixture."""
    from popquilt.functions import projections as P

    x0, y1 = (spark.range(1).select(P.mercator(P.longitude(F.lit(v)), F.lit(0.0), 150)[0]).first()[0] for v in (0.0, 0.0)), 0.0
    x0 = next(x0)
    data = [1.0] * 16 * 16
    mask = spark.createDataFrame([("AAA", 0, 0, 16, 16, [x0, 100.0, y1, -100.0], "itu", -9.0, data)], TILE.removeprefix("feature string, "))
    cat.write(mask, "itu_masks", iso3="AAA")
    version = "2025_06_21.001"
    stages.rake_fine(cat, "100", version, "AAA", TIME)
    out = cat.read("itu_results", iso3="AAA").select(F.explode("data").alias("v")).agg(F.sum("v")).first()[0]
    assert out == pytest.approx(1000, rel=1e-3)


def test_catalog_refuses(cat):
    with pytest.raises(ValueError):
        cat.read("tiles", resolution="7")
    with pytest.raises(ValueError):
        cat.path("nope")
    with pytest.raises(FileNotFoundError):
        cat.read("compiled_validation")
    with pytest.raises(FileNotFoundError):
        cat.info("nope")
    with pytest.raises(ValueError):
        stages.upsample(cat, "100", "v", TIME, "nope")
    assert not cat.exists("compiled_validation")


def test_command_line(cat):
    args = cli.parser().parse_args(["preprocess", "census_data", "--root", "x", "--iso3", "aaa"])
    assert (args.iso3, args.year) == ("AAA", "all")
    cli.run(cat, cli.parser().parse_args(["preprocess", "census_data", "--root", cat.root, "--iso3", "bbb"]))
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["postprocess", "rake", "--root", "x"])


def test_streamed_sums(spark, tmp_path):
    from popquilt.streaming import zonal

    for k in range(2):
        spark.createDataFrame([(1, 2.0), (2, 3.0), (1, None)], "zone int, value double").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema("zone int, value double, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    zonal.start(zonal.running_sums(stream, ["zone"]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = zonal.latest(spark.read.parquet(str(tmp_path / "out")), ["zone"]).collect()
    assert {r["zone"]: (r["value"], r["pixels"]) for r in got} == {1: (4.0, 2), 2: (6.0, 2)}
