"""Zonal sums kept up to date while pixel batches are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def running_sums(pixels: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Sums by zone of a stream of pixels; the state has one row a zone."""
    return pixels.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("pixels"))


def start(sums: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changed zones as a Parquet folder of its own, then stops at the input's end."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(batches: DataFrame, by: list[str]) -> DataFrame:
    """The last state of each zone from what ``start`` has written."""
    rest = [c for c in batches.columns if c not in (*by, "batch")]
    return batches.groupBy(*by).agg(*(F.max_by(c, "batch").alias(c) for c in rest))
