"""Writing masks, statistics and features."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def masks(pixels: DataFrame, path: str, overwrite: bool = False) -> None:
    """Set pixels by event, side and mosaic; an existing target is an error unless it may be
    overwritten."""
    named = pixels.withColumn("file", F.concat_ws("/", "event", "when", "mosaic", F.concat("tile", F.lit("_"), "channel", F.lit(".tif"))))
    dealt = named.repartition("event", "when", "mosaic", "tile")
    dealt.write.mode(mode(overwrite)).partitionBy("event", "when", "mosaic").parquet(path)


def csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode(mode(overwrite)).option("header", True).csv(path)


def geojson_lines(features: DataFrame, path: str, key: str = "QuadKey", overwrite: bool = False) -> None:
    """A JSON feature a line, in a folder for each key. geometry is a closed ring, or parts of
    such rings."""
    ring = lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))
    parts = isinstance(features.schema["geometry"].dataType.elementType, ArrayType)
    coordinates = F.transform("geometry", lambda p: F.transform(p, ring)) if parts else F.array(ring("geometry"))
    others = [c for c in features.columns if c not in ("geometry", key)]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("MultiPolygon" if parts else "Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(*others).alias("properties") if others else F.create_map().alias("properties"),
    )
    features.select(key, F.to_json(feature).alias("value")).write.mode(mode(overwrite)).partitionBy(key).text(path)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: what made it runs once, and a lost
    executor costs a re-read."""
    at = folder(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
