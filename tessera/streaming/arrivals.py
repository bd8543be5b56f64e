"""Streams: tiles that arrive in a folder, and event counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.catalog import not_done, path_parts


def arriving(spark: SparkSession, folder: str, schema: str, form: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(form).load(folder)


def new_tiles(stream: DataFrame, done: DataFrame) -> DataFrame:
    """Tiles of a stream of paths that a table of results lacks."""
    return not_done(stream.select("path", *path_parts(F.col("path"))), done, ["event", "when", "mosaic", "tile"])


def counts_by_window(events: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of each window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def append_results(stream: DataFrame, target: str, checkpoint: str):
    """Each batch is appended once; after a failure the stream goes on from its checkpoint."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
