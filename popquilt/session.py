"""A session with the settings that the operators expect, and the package for its workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the session's Python workers, once for each application, so that they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        at = f"{tempfile.mkdtemp(prefix='popquilt-')}/popquilt.zip"  # read by the driver's file server only
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent))
        sc.addPyFile(at)
        _shipped.add(sc.applicationId)
    return spark


def session(name: str = "popquilt", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew joins, UTC and dynamic partition overwrite; ``conf`` adds or replaces settings (``_`` for ``.``)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder in use, or the one the cluster names; a new one for local masters only."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.master.startswith("local"):
        return tempfile.mkdtemp(prefix="popquilt-")
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read from there from now on; Spark removes it when it is no longer used."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
