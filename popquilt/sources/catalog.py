"""Tables of a project: where they are, how they are read and written, and what is finished.

A table is a folder of Parquet under the root. Partition columns are part of the path, so
that a filter on them reads only its folders, and bounds are columns, so that a filter on
them skips row groups. All reading and writing goes through Spark, so that the root can be
on any store that Spark knows.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.functions.constants import NIGHT_LIGHT_YEARS, RESOLUTIONS
from popquilt.functions.keys import census_year_of, iso3_of, version_number
from popquilt.functions.semantics import clean
from popquilt.operators.geometry import bounds_of, meets_bounds
from popquilt.operators.model import Linear, Specification
from popquilt.sources import schemas

#: Partition columns of each table.
TABLES: dict[str, tuple[str, ...]] = {
    "tile_index": ("resolution",),
    "tiles": ("resolution", "provider", "time_point"),
    "census_counts": ("measure", "iso3", "year"),
    "shapefiles": ("purpose", "iso3", "year", "admin_level"),
    "census": ("iso3", "year"),
    "itu_masks": ("iso3",),
    "hierarchies": ("source",),
    "populations": ("source",),
    "wpp": ("version",),
    "shapes": ("source",),
    "raking_population": ("version",),
    "raking_shapes": ("version",),
    "raking_inputs": ("version", "measure"),
    "modeling_frame": ("resolution",),
    "validation_frame": ("resolution",),
    "features": ("resolution", "feature", "time_point"),
    "aliases": (),
    "people_per_structure": ("resolution", "tile_key"),
    "people_per_structure_summary": ("resolution",),
    "pixel_area_weights": ("resolution", "tile_key"),
    "training_rasters": ("resolution", "measure", "tile_key"),
    "models": ("resolution", "version"),
    "specifications": ("resolution", "version"),
    "raw_predictions": ("resolution", "version", "time_point"),
    "model_scores": ("resolution", "version"),
    "label_rasters": ("resolution", "raking_version"),
    "raking_factors": ("resolution", "version", "time_point"),
    "raked_predictions": ("resolution", "version", "time_point"),
    "compiled_predictions": ("resolution", "version", "spec", "time_point"),
    "raw_validation": ("resolution", "version"),
    "compiled_validation": ("resolution", "version"),
    "itu_results": ("resolution", "version", "iso3", "time_point"),
    "info": (),
}
CHUNK = 512


def check_resolution(resolution: str) -> str:
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution!r}; known are {RESOLUTIONS}")
    return resolution


class Catalog:
    """Reads and writes the tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"unknown table {table!r}")
        return f"{self.root}/{table}"

    def exists(self, table: str, **keys) -> bool:
        """Whether the table has rows with these keys; partition columns are looked up without reading rows."""
        try:
            return not self.read(table, **keys).limit(1).isEmpty()
        except FileNotFoundError:
            return False

    def _has_files(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, table: str, columns: list[str] | None = None, bounds=None, **keys) -> DataFrame:
        """Rows by keys (a value or a list for a column) and bounds; NaN is read as NULL.

        ``resolution`` is checked. ``bounds`` may be bounds, WKB or a polygon.
        """
        if "resolution" in keys and keys["resolution"] is not None:
            check_resolution(keys["resolution"])
        path = self.path(table)
        if not self._has_files(path):
            raise FileNotFoundError(path)
        df = self.spark.read.parquet(path)
        for k, v in keys.items():
            if v is not None:
                df = df.filter(F.col(k).isin(v) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
        if bounds is not None:
            df = df.filter(meets_bounds(*bounds_of(bounds)))
        return clean(df.select(*columns) if columns else df)

    def append(self, df: DataFrame, table: str, **keys) -> None:
        """Adds rows to what is there."""
        self.write(df, table, mode="append", **keys)

    def write(self, df: DataFrame, table: str, sort: list[str] | None = None, mode: str = "overwrite", **keys) -> None:
        """Replaces the partitions that the rows are of; keys become columns. Tables without partitions are replaced whole."""
        for k, v in keys.items():
            df = df.withColumn(k, F.lit(v))
        by = [c for c in TABLES[table] if c in df.columns]
        if dealt := [c for c in by if c not in keys]:
            # Rows of a partition meet, so that it gets few files; Spark splits large partitions and joins small ones.
            df = df.hint("rebalance", *dealt)
        if {"minx", "miny"} <= set(df.columns):
            df = df.sortWithinPartitions(*by, "minx", "miny")
        elif sort:
            df = df.sortWithinPartitions(*by, *sort)
        out = df.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
        (out.partitionBy(*by) if by else out).parquet(self.path(table))

    def values(self, table: str, *columns: str, **keys) -> DataFrame:
        """Distinct values of columns, sorted; of partition columns only the paths are read."""
        return self.read(table, **keys).select(*columns).distinct().orderBy(*columns)

    # Readers with rules of their own.

    def feature(self, resolution: str, name: str, time_point: str | None = None, block_key: str | None = None, bounds=None) -> DataFrame:
        """Tiles of a feature. A name that starts with ``log_`` is ln(1 + x) of the rest, and aliases are followed."""
        if name.startswith("log_"):
            base = self.feature(resolution, name[4:], time_point, block_key, bounds)
            return base.withColumn("data", F.transform("data", lambda x: F.log1p(x).cast("float")))
        name, time_point = self.resolve(resolution, name, time_point)
        return self.read("features", bounds=bounds, resolution=resolution, feature=name, time_point=time_point, block_key=block_key)

    def night_lights(self, resolution: str, year: int) -> DataFrame:
        """The night-light tiles of the nearest year there is."""
        first, last = NIGHT_LIGHT_YEARS
        return self.read("tiles", resolution=resolution, provider="nightlights", time_point=f"{min(max(year, first), last)}q1")

    def census(self, iso3: str, year: str, bounds=None, admin_level: int | None = None) -> DataFrame:
        return self.read("census", bounds=bounds, iso3=iso3, year=year, admin_level=admin_level)

    def deepest_level(self, iso3: str, year: str) -> int:
        return self.read("census", ["admin_level"], iso3=iso3, year=year).agg(F.max("admin_level")).first()[0]

    def read_counts(self, path: str) -> DataFrame:
        return clean(self.spark.read.csv(path, header=True, schema=schemas.CENSUS_COUNTS))

    def census_names(self, names: DataFrame) -> DataFrame:
        """(iso3, year) of names like ``{iso3}_{year}``."""
        return names.select(iso3_of(F.col("name")).alias("iso3"), census_year_of(F.col("name")).alias("year"))

    def raking_factors(self, resolution: str, version: str, time_point: str, block_key: str | None = None) -> DataFrame:
        return self.read("raking_factors", resolution=resolution, version=version, time_point=time_point, block_key=block_key)

    def ingest(self, sources: dict[str, DataFrame], table: str, key: str, renames: dict[str, str] | None = None) -> None:
        """Caches outside tables (already read by Spark) under one column, with the standard names."""
        for name, df in sources.items():
            self.write(clean(df.withColumnsRenamed(renames or {"loc_id": "location_id"})), table, **{key: name})

    # Aliases: a slice that is another one, without a copy.

    def link(self, resolution: str, feature: str, time_point: str, to_feature: str, to_time_point: str) -> None:
        row = self.spark.createDataFrame([(resolution, feature, time_point, to_feature, to_time_point)], "resolution string, feature string, time_point string, to_feature string, to_time_point string")
        row.write.mode("append").parquet(self.path("aliases"))

    def resolve(self, resolution: str, feature: str, time_point: str | None) -> tuple[str, str | None]:
        if time_point is None or not self._has_files(self.path("aliases")):
            return feature, time_point
        for _ in range(8):
            rows = self.read("aliases", resolution=resolution, feature=feature, time_point=time_point).limit(1).collect()
            if not rows:
                return feature, time_point
            feature, time_point = rows[0]["to_feature"], rows[0]["to_time_point"]
        raise ValueError(f"aliases of {feature} make a circle")

    # Versions and specifications.

    def next_version(self, resolution: str, day: date) -> str:
        """``%Y_%m_%d.NNN``: the day's last number and one."""
        last = self.last_version(resolution, day)
        return f"{day:%Y_%m_%d}.{(version_of(last) if last else 0) + 1:03d}"

    def last_version(self, resolution: str, day: date) -> str | None:
        if not self.exists("specifications"):
            return None
        own = self.read("specifications", resolution=resolution).filter(F.col("version").startswith(f"{day:%Y_%m_%d}."))
        return own.agg(F.max_by("version", version_number(F.col("version")))).first()[0]

    def write_specification(self, spec: Specification) -> None:
        row = self.spark.createDataFrame([(json.dumps(asdict(spec)),)], "text string")
        self.write(row.coalesce(1), "specifications", resolution=check_resolution(spec.resolution), version=spec.version)

    def specification(self, resolution: str, version: str) -> Specification:
        rows = self.read("specifications", resolution=resolution, version=version).collect()
        if not rows:
            raise FileNotFoundError(f"no specification {version}")
        return Specification(**json.loads(rows[0]["text"]))

    def write_model(self, model: Linear, resolution: str, version: str) -> None:
        rows = [("", model.intercept), *model.weights.items()]
        self.write(self.spark.createDataFrame(rows, "feature string, weight double").coalesce(1), "models", resolution=resolution, version=version)

    def model(self, resolution: str, version: str) -> Linear:
        w = {r["feature"]: r["weight"] for r in self.read("models", ["feature", "weight"], resolution=resolution, version=version).collect()}
        return Linear(w.pop(""), w)

    def copy_version(self, resolution: str, version: str, source: str) -> None:
        """A version with another one's model and predictions, which are read in place. It may be asked for again."""
        spec = self.specification(resolution, source)
        if self.exists("specifications", resolution=resolution, version=version):
            if self.specification(resolution, version).version != version or self.origin(resolution, version) != source:
                raise ValueError(f"version {version} is there and is not a copy of {source}")
            return
        self.write_specification(Specification(**(asdict(spec) | {"version": version})))
        self.link(resolution, f"version:{version}", "*", f"version:{source}", "*")

    def origin(self, resolution: str, version: str) -> str:
        """The version whose predictions stand for this one's."""
        return self.resolve(resolution, f"version:{version}", "*")[0].removeprefix("version:")

    def raw_predictions(self, resolution: str, version: str, time_point: str | None = None, block_key: str | None = None) -> DataFrame:
        return self.read("raw_predictions", resolution=resolution, version=self.origin(resolution, version), time_point=time_point, block_key=block_key)

    def unfinished(self, blocks: DataFrame, table: str, keys: list[str], **of) -> DataFrame:
        """Blocks that the table has no rows of."""
        if not self.exists(table, **of):
            return blocks
        return blocks.join(self.read(table, **of).select(*keys).distinct(), keys, "left_anti")

    # Frame information and other small settings.

    def write_info(self, name: str, value: dict) -> None:
        old = {}
        if self._has_files(self.path("info")):
            old = {r["name"]: r["value"] for r in self.spark.read.parquet(self.path("info")).collect()}
        rows = sorted((old | {name: json.dumps(value)}).items())
        self.spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(self.path("info"))

    def info(self, name: str) -> dict:
        rows = self.read("info").filter(F.col("name") == name).collect()
        if not rows:
            raise FileNotFoundError(f"no info {name}")
        return json.loads(rows[0]["value"])


def version_of(version: str) -> int:
    return int(version.rsplit(".", 1)[1])
