"""Measurements that keep arriving: files are read as a stream and merged into the stored long table, each cell once.

Nothing in the domain streams; this lets a compendium grow without being rebuilt. Deliveries may repeat and come late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "layer string, profile_id bigint, molecule_id string, value double, loaded_at timestamp"


def latest(cells: DataFrame) -> DataFrame:
    """One row per layer, profile and molecule: the last loaded, ties by the larger value."""
    return cells.groupBy("layer", "profile_id", "molecule_id").agg(F.max(F.struct("loaded_at", "value")).alias("r")).select("layer", "profile_id", "molecule_id", "r.value", "r.loaded_at")


def append(spark: SparkSession, arriving: str, store: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes each micro-batch of the Parquet files in ``arriving`` to ``store``, one folder per batch.

    A batch that is run again after a failure writes the same folder, so nothing is stored twice. Read with :func:`stored`."""
    stream = spark.readStream.schema(SCHEMA).parquet(arriving)

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The cells as they stand: the latest over all batches."""
    return latest(spark.read.schema(SCHEMA + ", batch bigint").parquet(store).drop("batch"))


def layer_counts(spark: SparkSession, arriving: str, delay: str = "1 day", window: str = "1 hour") -> DataFrame:
    """A stream of cells loaded per layer and window; a window closes when the watermark of ``delay`` has passed it."""
    stream = spark.readStream.schema(SCHEMA).parquet(arriving).withWatermark("loaded_at", delay)
    return stream.groupBy(F.window("loaded_at", window), "layer").agg(F.count("*").alias("cells")).select(F.col("window.start").alias("start"), "layer", "cells")
