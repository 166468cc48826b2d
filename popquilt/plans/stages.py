"""The stages of a population model, each a Spark job over the catalog's tables.

A stage covers all countries, blocks and time points that it is asked for in one plan, so
that nothing is run block by block. Predictions and features are tiles in an equal-area
system; a pixel's global cell is (floor(x / cell), floor(y / cell)).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popquilt.functions import projections as P
from popquilt.functions.constants import BUILT_VERSIONS, CRS, DERIVED, UPSAMPLE
from popquilt.functions.semantics import nan_to_null, total
from popquilt.operators import allocate, census, model, pixel_model, raster, spatial_join, timeaxis
from popquilt.operators import geometry as G
from popquilt.operators import polygons as PG
from popquilt.operators import rake as rk
from popquilt.operators import raking_population as R
from popquilt.sources.catalog import Catalog

CELL = ["block_key", "row", "col"]
PLACE = ["block_key", "chunk_row", "chunk_col"]
TILE = [*PLACE, "height", "width", "transform", "crs", "nodata"]
#: Cells along a side of the grid in which polygons and pixels meet.
JOIN_CELLS = 256
NAN = float("nan")


def cell_size(cat: Catalog) -> float:
    return float(cat.info("frame")["cell"])


def long_view(tiles: DataFrame, cell: float, *keep: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """Pixels with their global cell (gx, gy)."""
    p = raster.pixels(tiles, keep, beside)
    return p.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})


def as_tiles(long: DataFrame, like: DataFrame, by: tuple[str, ...] = ("block_key",)) -> DataFrame:
    """Pixels back in chunks of the size and place of another tile table."""
    shape = like.select("height", "width").first()
    made = raster.to_tiles(long, shape["height"], shape["width"], by)
    place = like.groupBy("block_key", "chunk_row", "chunk_col").agg(F.first("transform").alias("transform"), F.first("crs").alias("crs"), F.first("nodata").alias("nodata"))
    return made.join(place, ["block_key", "chunk_row", "chunk_col"])


def polygons(df: DataFrame) -> DataFrame:
    return df if "minx" in df.columns else G.with_bounds(df)


# Preprocessing


def census_data(cat: Catalog, iso3: str = census.RUN_ALL, year: str = census.RUN_ALL, repair: float | None = None, reproject: float | None = None) -> None:
    """Counts joined to shapes, all countries in one job; shapes and counts must match one to one.

    With ``repair``, the side of a cell, shapes are made valid. With ``reproject``, a tolerance,
    shapes are in longitude and latitude and go to the equal-area system; countries that are
    beyond 170 degrees as a whole go to the one about the anti-meridian.
    """
    runs = census.select_runs(cat.read("shapefiles", purpose="training").select("iso3", "year").distinct(), iso3, year)
    keys = ["iso3", "year"]
    counts = (
        cat.read("census_counts").join(runs, keys, "left_semi").groupBy(*keys, "shape_id").pivot("measure", ["population_total", "household_total"]).agg(F.max("value"))
    )
    shapes = cat.read("shapefiles", purpose="training").join(runs, keys, "left_semi")
    if repair:
        shapes = PG.repaired(shapes.drop("minx", "miny", "maxx", "maxy"), [*keys, "shape_id"], repair)
    if reproject:
        own = polygons(shapes).withColumn("_crs", G.working_crs(F.min("minx").over(Window.partitionBy("iso3")), F.max("maxx").over(Window.partitionBy("iso3"))))
        shapes = reduce(DataFrame.unionByName, [PG.reprojected(own.filter(F.col("_crs") == c), CRS[c], reproject) for c in ("equal_area", "equal_area_anti_meridian")]).drop("_crs")
    shapes = polygons(shapes)
    whole = F.concat_ws("/", *keys, "shape_id")
    both = census.join_counts(shapes.withColumn("_id", whole).withColumnRenamed("shape_id", "_s").withColumnRenamed("_id", "shape_id"), counts.withColumn("shape_id", whole).drop(*keys))
    cat.write(both.drop("shape_id").withColumnRenamed("_s", "shape_id").select(*keys, *census.CENSUS_COLUMNS, "minx", "miny", "maxx", "maxy"), "census")


def raking_data(cat: Catalog, version: str = "primary", overridden: list[int] = (), drop_children_of: list[int] = ()) -> None:
    """Raking population and shapes from the ingested series; raises where they do not match."""
    spark = cat.spark
    hierarchy = cat.read("hierarchies", source="primary").drop("source")
    primary = cat.read("populations", source="primary").select("location_id", "year_id", "population").join(hierarchy, "location_id")
    forecast = None
    if version.startswith("forecast"):
        forecast = cat.read("populations", source="forecast").select("location_id", "year_id", "population").join(cat.read("hierarchies", source="forecast").drop("source"), "location_id")
    dropped = spark.createDataFrame([(x,) for x in drop_children_of], "location_id int")
    wpp = cat.read("wpp").select("iso3", "year_id", "population")
    supplement = cat.read("raking_inputs", measure="supplement").select("location_id", "location_name", "region_id", "location_code", "category")
    population = R.build(wpp, primary, hierarchy, supplement, dropped, forecast)
    shapes = R.raking_shapes(cat.read("shapes", source="primary").drop("source"), cat.read("shapes", source="fallback").drop("source"), list(overridden), population)
    R.validate(population, shapes)
    cat.write(population, "raking_population", version=version)
    cat.write(polygons(shapes), "raking_shapes", version=version)


# Model preparation


def modeling_frame(cat: Catalog, resolution: str, info: dict | None = None) -> None:
    """Tiles with geometry and ten splits, and the blocks of each census country and year."""
    if info:
        cat.write_info("frame", info)
    index = cat.read("tile_index", resolution=resolution).select("tile_key", "block_key", "minx", "miny", "maxx", "maxy")
    wide = model.splits(index).groupBy("tile_key").pivot("split_number", list(range(model.SPLITS))).agg(F.first("split"))
    wide = wide.select("tile_key", *(F.col(str(k)).alias(f"split_{k}") for k in range(model.SPLITS)))
    frame = index.join(wide, "tile_key").withColumn("geometry", G.st_box("minx", "miny", "maxx", "maxy"))
    cat.write(frame, "modeling_frame", resolution=resolution)
    blocks = spatial_join.dissolve(index, "block_key").select("block_key", *(F.col(a).alias(b) for a, b in zip(("minx", "miny", "maxx", "maxy"), ("bx0", "by0", "bx1", "by1"))))
    units = census.deepest(cat.read("census"), ("iso3", "year"))
    met = spatial_join.pairs(units, blocks, cell_size(cat) * JOIN_CELLS).select("iso3", F.col("year").cast("string").alias("year"), "block_key").distinct()
    cat.write(met, "validation_frame", resolution=resolution)


def features(cat: Catalog, resolution: str, built_version: str, height: str | None = None) -> None:
    """Derived measures at the version's time points, interpolated ones between, and aliases beyond."""
    v = BUILT_VERSIONS[built_version]
    cell = cell_size(cat)
    source = {"density": v.name, "height": v.name if v.has_height else height or "ghsl_r2023a", "proportion_residential": "ghsl_r2023a"}
    at = list(v.time_points)

    def band(name: str) -> DataFrame:
        return long_view(cat.read("tiles", resolution=resolution, provider=source[name], time_point=at).filter(F.col("feature") == name), cell, "time_point").select("time_point", *CELL, F.col("value").alias(name))

    tiles = cat.read("tiles", resolution=resolution, provider=source["density"], time_point=at).filter(F.col("feature") == "density")
    bands = band("density").join(band("height"), ["time_point", *CELL]).join(band("proportion_residential"), ["time_point", *CELL])
    by_time = F.concat_ws("|", "time_point", "block_key")
    made = raster.derived_measures(bands.withColumn("block_key", by_time)).select(
        F.split("block_key", r"\|")[0].alias("time_point"), F.split("block_key", r"\|")[1].alias("block_key"), "row", "col", F.concat(F.lit(f"{v.name}_"), "measure").alias("feature"), "value"
    )
    plan = timeaxis.strategies(cat.spark).filter(F.col("version") == v.name)
    between = plan.filter("strategy = 'interpolate'").select("time_point")
    names = cat.spark.createDataFrame([(f"{v.name}_{m}",) for m in DERIVED], "feature string")
    mixed = timeaxis.interpolate(made, names.crossJoin(F.broadcast(between)), ["feature"], CELL)
    whole = made.unionByName(mixed.select(*made.columns))
    cat.write(as_tiles(whole, tiles, ("feature", "time_point", "block_key")), "features", resolution=resolution)
    for row in plan.filter("strategy = 'skip'").collect():  # a version has some dozens of time points
        for m in DERIVED:
            cat.link(resolution, f"{v.name}_{m}", row["time_point"], f"{v.name}_{m}", row["copy_of"])


def night_lights(cat: Catalog, resolution: str, time_points: list[str], distance: int = 100, how: str = "interpolate") -> None:
    """Night lights of each time point's nearest year; missing cells are filled from lights within ``distance`` cells, also across tiles, else none."""
    for t in time_points:
        tiles = cat.night_lights(resolution, int(t[:4]))
        absent = lambda v: F.when(F.isnan(v) | (v == F.coalesce("nodata", F.lit(NAN))), F.lit(NAN)).otherwise(F.coalesce(v, F.lit(NAN)))
        tiles = raster.fill_across(tiles.withColumn("data", F.transform("data", lambda v: absent(v.cast("double")))), distance, how)
        light = raster.night_lights(long_view(tiles, cell_size(cat)).select(*CELL, "value")).select(*CELL, "value")
        cat.write(as_tiles(light, tiles), "features", resolution=resolution, feature="nighttime_lights", time_point=t)


def averages(cat: Catalog, resolution: str, feature: str, time_point: str, radii: list[float], kind: str = "gaussian") -> None:
    """Neighbourhood averages of a feature, across the edges of blocks."""
    tiles = cat.feature(resolution, feature, time_point)
    place = tiles.select("block_key", "chunk_row", "chunk_col", "transform", "crs", "nodata")
    for r in radii:
        made = raster.average_with_neighbours(tiles, cell_size(cat), r, kind).join(place, ["block_key", "chunk_row", "chunk_col"])
        cat.write(made, "features", resolution=resolution, feature=f"{feature}_{r:g}m", time_point=time_point)


def training_data(cat: Catalog, resolution: str, time_point: str, denominators: list[str], years: dict[str, str]) -> None:
    """Census units cut by pixels, and people allocated by each denominator. ``years`` gives each country's census."""
    cell = cell_size(cat)
    wanted = cat.spark.createDataFrame(sorted(years.items()), "iso3 string, _year string")
    units = cat.read("census").withColumn("_year", F.col("year").cast("string")).join(F.broadcast(wanted), ["iso3", "_year"], "left_semi")
    units = census.deepest(units).withColumn("admin_area", G.st_area("geometry"))
    cut = spatial_join.overlay(units.select(F.col("shape_id").alias("admin_id"), F.col("population_total").alias("admin_population"), "admin_area", "geometry", "minx", "miny", "maxx", "maxy"), cell)
    built = None
    for d in denominators:
        one = long_view(cat.feature(resolution, d, time_point), cell).select(*CELL, "gx", "gy", F.col("value").alias("pixel_value"), F.lit(d).alias("denominator"))
        built = one if built is None else built.unionByName(one)
    frame = cat.read("modeling_frame", resolution=resolution).select("tile_key", "block_key", "minx", "miny", "maxx", "maxy")
    x, y = (F.col("gx") + 0.5) * cell, (F.col("gy") + 0.5) * cell
    inside = (x >= F.col("minx")) & (x < F.col("maxx")) & (y >= F.col("miny")) & (y < F.col("maxy"))
    pixel = built.join(frame, "block_key").filter(inside).drop("minx", "miny", "maxx", "maxy").withColumn("pixel_id", F.concat_ws("_", "gy", "gx"))
    rows = (
        cut.drop("geometry", "minx", "miny", "maxx", "maxy")
        .join(pixel, (F.col("grid_col") == F.col("gx")) & (F.col("grid_row") == F.col("gy")))
        .withColumns({"pixel_area": F.lit(cell * cell), "time_point": F.lit(time_point)})
    )
    done = allocate.allocate(rows.drop("grid_col", "grid_row"))
    cat.write(done, "people_per_structure", resolution=resolution)
    cat.write(allocate.pixel_weights(done), "pixel_area_weights", resolution=resolution)
    summary = allocate.one_per_admin(done).join(done.groupBy("admin_id").agg(F.min("tile_key").alias("tile_key")), "admin_id")
    cat.write(summary, "people_per_structure_summary", resolution=resolution)
    cat.write(training_rasters(done, frame, cell), "training_rasters", resolution=resolution)


def training_rasters(allocated: DataFrame, frame: DataFrame, cell: float) -> DataFrame:
    """Rasters of the tiles with what pixels are trained on: people and rates by denominator, and whether a unit of the pixel lies in several tiles; 0 where nobody lives."""
    of = lambda name: F.concat(F.lit(f"{name}_"), "denominator")
    pixel = allocated.groupBy("tile_key", "gx", "gy", "denominator").agg(
        *(F.max(f"pixel_{m}").alias(m) for m in ("population", "occupancy_rate", "log_occupancy_rate")), F.max("admin_multi_tile").cast("double").alias("multi_tile")
    )
    measures = F.array(
        *(F.struct(of(m).alias("measure"), F.col(m).alias("value")) for m in ("population", "occupancy_rate", "log_occupancy_rate")),
        F.struct(F.lit("multi_tile").alias("measure"), F.col("multi_tile").alias("value")),
    )
    corner = frame.select("tile_key", "block_key", F.round(F.col("minx") / cell).cast("long").alias("_left"), F.round(F.col("maxy") / cell).cast("long").alias("_top"), F.array(*(c.cast("double") for c in (F.col("minx"), F.lit(cell), F.col("maxy"), F.lit(-cell)))).alias("transform"))
    height, width = frame.agg(*(F.max(F.round((F.col(b) - F.col(a)) / cell)).cast("int") for a, b in (("miny", "maxy"), ("minx", "maxx")))).first()
    long = pixel.select("tile_key", "gx", "gy", F.explode(measures).alias("m")).join(corner.select("tile_key", "_left", "_top"), "tile_key")
    long = long.select("tile_key", F.col("m.measure").alias("measure"), (F.col("_top") - 1 - F.col("gy")).cast("int").alias("row"), (F.col("gx") - F.col("_left")).cast("int").alias("col"), F.col("m.value").alias("value"))
    rasters = raster.to_tiles(long, height, width, ("measure", "tile_key"), 0.0)
    return rasters.join(corner.select("tile_key", "block_key", "transform"), "tile_key").withColumns({"crs": F.lit("equal_area"), "nodata": F.lit(NAN)})


# The model


def feature_columns(cat: Catalog, resolution: str, names: list[str], time_point: str) -> DataFrame:
    """(gx, gy, one column a feature): all features of a time point side by side, gathered in one shuffle."""
    cell = cell_size(cat)
    parts = [long_view(cat.feature(resolution, f, time_point), cell).select("gx", "gy", F.lit(f).alias("feature"), "value") for f in names]
    return reduce(DataFrame.unionByName, parts).groupBy("gx", "gy").pivot("feature", names).agg(F.first("value"))


def train_pixels(cat: Catalog, spec: model.Specification) -> model.Linear:
    """Fits a model of pixels to units (or pixels) of the split's training tiles; validation tiles tell when to stop.

    Pixels are those with people in which every unit lies in one tile; units those that
    ``train`` takes. Scores compare what the loss compares, and people.
    """
    cell, features = cell_size(cat), list(spec.features)
    frame = cat.read("modeling_frame", resolution=spec.resolution).select("tile_key", F.col(f"split_{spec.split}").alias("split"))
    people = cat.read("people_per_structure", resolution=spec.resolution).filter(F.col("denominator") == spec.denominator)
    time_point = people.agg(F.max("time_point")).first()[0]
    pixels = allocate.training_pixels(people.groupBy("tile_key", "pixel_id", "gx", "gy").agg(F.max("admin_multi_tile").alias("admin_multi_tile"), *(F.max(c).alias(c) for c in ("pixel_value", "pixel_population", "pixel_occupancy_rate", "pixel_log_occupancy_rate"))))
    if features:
        pixels = pixels.join(feature_columns(cat, spec.resolution, features, time_point), ["gx", "gy"])
    pixels = pixels.withColumnRenamed("pixel_value", "built").join(frame, "tile_key")
    units = cat.read("people_per_structure_summary", resolution=spec.resolution).filter(F.col("denominator") == spec.denominator)
    units = allocate.training_units(units, frame).join(frame, "tile_key")
    weights = cat.read("pixel_area_weights", resolution=spec.resolution)

    def rows(level: str, target: str) -> DataFrame:
        base = target.removeprefix("log_") if target.endswith("population_density") else target
        y = F.col(f"{level}_population") / (cell * cell) if base == "population_density" else F.col(f"{level}_{base}")
        y = F.log(y) if base != target else y
        if level == "pixel":
            return pixel_model.pixel_rows(pixels.withColumn("y", y), features)
        return pixel_model.unit_rows(weights, pixels, units.withColumn("y", y), features)

    kind, (level, target) = spec.target.removeprefix("pixel_"), spec.loss_target.split("_", 1)
    fitted = pixel_model.fit(rows(level, target), kind, target, features, spec.loss_metric, spec.optimizer, spec.learning_rate, spec.rounds, patience=spec.patience, area=cell * cell).model
    found = [pixel_model.scores(rows(level, t), kind, t, fitted, area=cell * cell).withColumn("target", F.lit(t)) for t in dict.fromkeys((target, "population"))]
    cat.write_model(fitted, spec.resolution, spec.version)
    cat.write(reduce(DataFrame.unionByName, found), "model_scores", resolution=spec.resolution, version=spec.version)
    cat.write_specification(spec)
    return fitted


def train(cat: Catalog, spec: model.Specification) -> model.Linear:
    """Fits on the units of the split's training tiles; keeps model, specification, and the scores of all three parts.

    Scores compare the output with the model's target, and people with counted people. A
    target of pixels goes to ``train_pixels``.
    """
    if spec.target.startswith("pixel_"):
        return train_pixels(cat, spec)
    frame = cat.read("modeling_frame", resolution=spec.resolution).select("tile_key", F.col(f"split_{spec.split}").alias("split"))
    units = cat.read("people_per_structure_summary", resolution=spec.resolution).filter(F.col("denominator") == spec.denominator)
    rows = allocate.training_units(units, frame)
    time_point = cat.read("people_per_structure", ["time_point"], resolution=spec.resolution).agg(F.max("time_point")).first()[0]
    for f in spec.features:
        values = long_view(cat.feature(spec.resolution, f, time_point), cell_size(cat)).select("gx", "gy", "value")
        weights = cat.read("pixel_area_weights", resolution=spec.resolution).withColumns({"gy": F.split("pixel_id", "_")[0].cast("long"), "gx": F.split("pixel_id", "_")[1].cast("long")})
        means = weights.join(values, ["gx", "gy"]).groupBy("admin_id").agg(F.sum(F.col("value") * F.col("weight")).alias(f))
        rows = rows.join(means, "admin_id")
    fitted = model.fit_least_absolute(model.part(rows, frame, "train"), spec.target, list(spec.features))
    cat.write_model(fitted, spec.resolution, spec.version)
    kind = spec.target.removeprefix("admin_")
    found = [model.scores(rows, frame, fitted, kind, kind, spec.target, built=spec.target).withColumn("target", F.lit(kind))]
    if {"admin_built", "admin_population"} <= set(rows.columns):
        found.append(model.scores(rows, frame, fitted, kind, "population", "admin_population", built="admin_built", area=1.0).withColumn("target", F.lit("population")))
    cat.write(reduce(DataFrame.unionByName, found), "model_scores", resolution=spec.resolution, version=spec.version)
    cat.write_specification(spec)
    return fitted


def known() -> Column:
    """A tile's data as doubles, NULL where there is none."""
    absent = lambda v: F.isnan(v) | (v == F.coalesce("nodata", F.lit(NAN)))
    return F.transform("data", lambda v: F.when(~absent(v.cast("double")), v.cast("double")))


def inference(cat: Catalog, resolution: str, version: str, time_points: list[str]) -> None:
    """Predicted population of every block; blocks that are there already are left alone.

    Tiles of the denominator and the features meet as they are, and the model is an
    expression of their arrays: no pixel is shuffled.
    """
    spec, fitted = cat.specification(resolution, version), cat.model(resolution, version)
    for t in time_points:
        tiles = cat.unfinished(cat.feature(resolution, spec.denominator, t), "raw_predictions", ["block_key"], resolution=resolution, version=version, time_point=t)
        if tiles.isEmpty():
            continue
        whole = tiles.select(*TILE, known().alias("built"))
        for k, f in enumerate(spec.features):
            whole = whole.join(cat.feature(resolution, f, t).select(*PLACE, known().alias(f"_f{k}")), PLACE, "left")
        names = {f: f"_f{k}" for k, f in enumerate(spec.features)}
        same = [F.coalesce(F.size(F.col(c)) == F.size("built"), F.lit(True)) for c in names.values()]
        checked = F.when(reduce(lambda a, b: a & b, same, F.lit(True)), F.arrays_zip("built", *names.values())).otherwise(F.raise_error(F.lit("features are not on one grid")))
        data = F.transform(checked, lambda x: (F.exp(sum((x[names[f]] * w for f, w in fitted.weights.items()), F.lit(fitted.intercept))) * x["built"]).cast("float"))
        cat.append(whole.select(*TILE, data.alias("data")), "raw_predictions", resolution=resolution, version=version, time_point=t)


# After the model


def _labelled(cat: Catalog, resolution: str, version: str, time_point: str, raking_version: str) -> DataFrame:
    """Predicted pixels with the last location that covers them, from the label raster."""
    tiles, place = cat.raw_predictions(resolution, version, time_point), ["block_key", "chunk_row", "chunk_col"]
    label_raster(cat, tiles, resolution, raking_version)
    labels = cat.read("label_rasters", resolution=resolution, raking_version=raking_version).select(*place, F.col("data").alias("location_id"))
    pixels = long_view(tiles.join(labels, place, "left"), cell_size(cat), beside=("location_id",))
    return pixels.select(*CELL, "x", "y", "value", F.col("location_id").cast("int").alias("location_id"))


def label_raster(cat: Catalog, tiles: DataFrame, resolution: str, raking_version: str) -> None:
    """Writes the locations of the tiles' pixels, once for each block: they do not depend on the time point."""
    todo = cat.unfinished(tiles, "label_rasters", ["block_key"], resolution=resolution, raking_version=raking_version)
    if todo.isEmpty():
        return
    cell = cell_size(cat)
    shapes = cat.read("raking_shapes", version=raking_version).select("location_id", "geometry", "minx", "miny", "maxx", "maxy", F.col("location_id").alias("ordinal"))
    placed = spatial_join.labelled(long_view(todo, cell).select(*CELL, "x", "y"), shapes, cell * JOIN_CELLS, CELL, "ordinal", "location_id")
    made = as_tiles(placed.select(*CELL, F.col("location_id").cast("double").alias("value")), todo)
    cat.append(made, "label_rasters", resolution=resolution, raking_version=raking_version)


def raking_factors(cat: Catalog, resolution: str, version: str, time_points: list[str], raking_version: str = "primary", last_year: int | None = None) -> None:
    """Factors by block and location; locations without any predicted people have none."""
    wanted = cat.spark.createDataFrame([(t,) for t in time_points], "time_point string")
    targets = timeaxis.quarterly(cat.read("raking_population", version=raking_version).select("location_id", "year_id", "population"), wanted, last_year=last_year)
    sources = timeaxis.prediction_time(wanted, cat.values("raw_predictions", "time_point", resolution=resolution, version=cat.origin(resolution, version))).collect()
    for row in sources:  # one for each time point that was asked for
        if not row["available"]:
            raise ValueError(f"{row['time_point']}: {row['source']} was not predicted")
        pixels = _labelled(cat, resolution, version, row["source"], raking_version)
        sums = pixels.filter("location_id is not null").groupBy("block_key", "location_id").agg(total("value").alias("value"))
        found = rk.by_block(rk.factors(sums, targets.filter(F.col("time_point") == row["time_point"]).drop("time_point")), sums)
        cat.write(found, "raking_factors", resolution=resolution, version=version, time_point=row["time_point"])


def rake(cat: Catalog, resolution: str, version: str, time_points: list[str], raking_version: str = "primary") -> None:
    """Predictions times their location's factor, missing outside all locations.

    A tile meets its labels and the few factors of its block; no pixel is shuffled.
    """
    have = cat.values("raw_predictions", "time_point", resolution=resolution, version=cat.origin(resolution, version))
    for row in timeaxis.prediction_time(cat.spark.createDataFrame([(t,) for t in time_points], "time_point string"), have).collect():
        tiles = cat.raw_predictions(resolution, version, row["source"])
        label_raster(cat, tiles, resolution, raking_version)
        labels = cat.read("label_rasters", resolution=resolution, raking_version=raking_version).select(*PLACE, F.transform("data", lambda v: F.when(~F.isnan(v), v).cast("int")).alias("_labels"))
        factor = cat.raking_factors(resolution, version, row["time_point"]).filter("raking_factor is not null")
        factor = factor.groupBy("block_key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("location_id").cast("int"), "raking_factor"))).alias("_factors"))
        both = tiles.select(*TILE, known().alias("_values")).join(labels, PLACE, "left").join(factor, "block_key", "left")
        data = F.zip_with("_values", "_labels", lambda v, k: (v * F.try_element_at("_factors", k)).cast("float"))
        data = F.coalesce(data, F.transform("_values", lambda v: F.lit(None).cast("float")))
        cat.write(both.select(*TILE, data.alias("data")), "raked_predictions", resolution=resolution, version=version, time_point=row["time_point"])


def rake_fine(cat: Catalog, resolution: str, version: str, iso3: str, time_point: str, raking_version: str = "primary", distance: int = 100) -> None:
    """Predictions summed to the cells of a country's finer mask and raked there to the UN series.

    The mask is one tile in its own Mercator system; cells inside without a location take the
    nearest one's.
    """
    mask, cell = cat.read("itu_masks", iso3=iso3), cell_size(cat)
    first = mask.select("transform", "height", "width").first()
    (x0, dx, y0, dy), h, w = first["transform"], first["height"], first["width"]
    meridian = CRS["itu_anti_meridian"].meridian
    p = long_view(cat.raw_predictions(resolution, version, time_point), cell)
    lon, lat = P.longitude(F.col("x")), P.latitude(F.col("y"))
    x, y = P.mercator(lon, lat, meridian)
    summed = raster.warp(p.select("x", "y", "value"), x, y, (x0, y0 + dy * h, x0 + dx * w, y0), dx, "sum")
    shapes = cat.read("raking_shapes", version=raking_version).select("location_id", "geometry", "minx", "miny", "maxx", "maxy", F.col("location_id").alias("ordinal"))
    cells = raster.pixels(mask).filter("value = 1")
    back_lon = F.pmod(P.longitude(F.col("x"), meridian) + 180, F.lit(360.0)) - 180
    back_lat = F.degrees(P.repeated(F.lit(0.0), lambda t: F.asin(F.tanh(F.col("y") / P.A + P.E * F.atanh(P.E * F.sin(t)))), 8))
    ex, ey = P.equal_area(back_lon, back_lat)
    at = cells.select("block_key", "row", "col", ex.alias("x"), ey.alias("y"))
    placed = spatial_join.labelled(at, shapes, cell * JOIN_CELLS, CELL, "ordinal", "location_id")
    known = raster.to_tiles(placed.select(*CELL, F.col("location_id").cast("double").alias("value")), h, w).select("block_key", "height", "width", F.transform("data", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("data"))
    filled = raster.fill_nearest(known, distance).select("block_key", F.posexplode("data").alias("_p", "_v"))
    places = filled.select("block_key", F.floor(F.col("_p") / w).cast("int").alias("row"), (F.col("_p") % w).cast("int").alias("col"), nan_to_null(F.col("_v")).cast("int").alias("location_id"))
    inside = places.join(cells.select(*CELL), CELL, "left_semi")
    targets = timeaxis.quarterly(cat.read("raking_population", version=raking_version).select("location_id", "year_id", F.col("wpp_population").alias("population")), cat.spark.createDataFrame([(time_point,)], "time_point string"))
    raked = rk.rake_fine(summed, inside, targets.drop("time_point")).select(F.lit(iso3).alias("block_key"), "row", "col", F.col("raked").alias("value"))
    cat.write(raster.to_tiles(raked, h, w), "itu_results", resolution=resolution, version=version, iso3=iso3, time_point=time_point)


def mosaic(cat: Catalog, resolution: str, version: str, time_point: str) -> DataFrame:
    """Raked tiles with their group's key: a view, for a group is a filter."""
    return raster.mosaic(cat.read("raked_predictions", resolution=resolution, version=version, time_point=time_point))


def upsample(cat: Catalog, resolution: str, version: str, time_point: str, spec: str) -> None:
    """Raked pixels on one of the output grids, written as pixels (row, col, value)."""
    if spec not in UPSAMPLE:
        raise ValueError(f"unknown grid {spec!r}; known are {sorted(UPSAMPLE)}")
    name, size, how = UPSAMPLE[spec]
    crs = CRS[name]
    p = long_view(cat.read("raked_predictions", resolution=resolution, version=version, time_point=time_point), cell_size(cat)).filter("value is not null")
    half = cell_size(cat) / 2
    corners = ((F.col("x") - half, F.col("y") - half), (F.col("x") + half, F.col("y") + half))
    if crs.projection != "cea":
        corners = tuple(P.project(crs.projection, P.longitude(x), P.latitude(y), crs.meridian) for x, y in corners)
    out = raster.warp_footprints(p, (*corners[0], *corners[1]), crs.bounds, size, how)
    cat.write(out, "compiled_predictions", resolution=resolution, version=version, spec=spec, time_point=time_point)


def metrics(cat: Catalog, resolution: str, versions: list[str], time_point: str, raked: bool = True) -> None:
    """Raked population of each census's deepest units, for each version; that before raking without ``raked``."""
    cell = cell_size(cat)
    units = census.deepest(cat.read("census"), ("iso3", "year")).withColumn("label", F.concat_ws("/", "iso3", "year", "shape_id"))
    shapes = units.select("label", F.col("label").alias("ordinal"), "geometry", "minx", "miny", "maxx", "maxy", "iso3", "year")
    for version in versions:
        tiles = cat.read("raked_predictions", resolution=resolution, version=version, time_point=time_point) if raked else cat.raw_predictions(resolution, version, time_point)
        pixels = long_view(tiles, cell).select(*CELL, "x", "y", "value")
        inside = spatial_join.points_in(pixels, shapes, cell * JOIN_CELLS)
        one = inside.groupBy("iso3", "year", *CELL).agg(F.max("label").alias("label"), F.first("value").alias("value"))
        out = census.pixel_metrics(one, units.select("label", "shape_id", "iso3", F.col("year").cast("string").alias("year")))
        cat.write(out, "raw_validation", resolution=resolution, version=version)
