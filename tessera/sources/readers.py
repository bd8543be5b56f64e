"""Reading catalogues, features and listings. Every schema is declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import line_from_json, parts_from_json
from tessera.operators.catalog import path_parts

EVENT_DATES = "event string, aligned string, date string, month int, day int, year int, date2 string"
EVENT_REGIONS = "event_id string, state string, region string"
REGION_COUNTRIES = "region_name string, countries string"
ROAD_LINKS = "region string, link string"
BUILDING_LINKS = "Location string, QuadKey string, Url string"
FOOTPRINTS = "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>"
MOSAIC_ITEM = "quadkey string, `proj:bbox` string, `proj:epsg` int, `tile:data_area` double, datetime string, catalog_id string, visual string"


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """With a header line. Columns go by place, so a byte order mark in the header is no
    matter; rows without any value are left out."""
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", True).csv(path)
    return rows.where(F.coalesce(*(F.col(f"`{c}`").cast("string") for c in rows.columns)).isNotNull())


def event_dates(spark: SparkSession, path: str) -> DataFrame:
    """Events with an aligned name, and their day."""
    rows = csv(spark, path, EVENT_DATES, ";").where("aligned is not null")
    return rows.select(F.col("aligned").alias("event"), F.to_date("date").alias("event_date"))


def region_countries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(REGION_COUNTRIES).option("header", True).option("escape", '"').csv(path)
    listed = F.from_json(F.translate("countries", "'", '"'), "array<string>")
    return rows.select("region_name", F.explode(listed).alias("country"))


def roads(spark: SparkSession, paths: list[str], with_country: bool = True) -> DataFrame:
    """Lines of tab-separated files without a header: country and a JSON feature, or the
    feature alone. Malformed features are empty lines."""
    schema = "country string, feature string" if with_country else "feature string"
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(paths)
    country = F.col("country") if with_country else F.lit(None).cast("string")
    return rows.select(country.alias("country"), line_from_json(F.col("feature")).alias("geometry"))


def footprints(spark: SparkSession, links: DataFrame, quadkeys: DataFrame) -> DataFrame:
    """Buildings from the files that links name for some quadkeys, in one read. Without any
    such file, an empty table. parts has all polygons and holes of a feature, geometry the first
    outer ring."""
    urls = links.join(quadkeys, "QuadKey", "left_semi").select("Url").distinct()
    paths = [r.Url for r in urls.collect()]  # a path each, as the reader takes them
    raw = spark.read.schema(FOOTPRINTS).json(paths) if paths else spark.createDataFrame([], FOOTPRINTS)
    shaped = raw.select(parts_from_json(F.col("geometry.type"), F.col("geometry.coordinates")).alias("parts"), "properties")
    return shaped.select(F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("geometry"), "parts", "properties")


def mosaic_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of GeoJSON collections, with their box as four columns."""
    schema = f"features array<struct<properties:struct<{MOSAIC_ITEM.replace(' ', ':').replace(',:', ',')}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    items = rows.select(F.explode("features.properties").alias("p")).select("p.*")
    box = F.transform(F.split("proj:bbox", ","), lambda s: F.trim(s).cast("double"))
    return items.withColumns({n: F.get(box, i) for i, n in enumerate(("x0", "y0", "x1", "y1"))}).withColumnRenamed("proj:epsg", "srid")


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below a folder; content is read if it is asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def listing(spark: SparkSession, root: str, pattern: str = "*.tif") -> DataFrame:
    """Files below a folder as a table; their content is not read."""
    return files(spark, root, pattern).select("path", "length", "modificationTime")


def tiles(spark: SparkSession, root: str) -> DataFrame:
    found = listing(spark, root)
    return found.select("path", *path_parts(F.col("path")))


def windows(tiles_: DataFrame, patches: DataFrame, decode, schema: str) -> DataFrame:
    """Reads windows of rasters: tiles (tile, path) with patches (tile, row, col, height,
    width), each file opened once for its patches. ``decode(bytes, row, col, height, width)``
    gives an array as a list, or None if the file has no such window."""
    wanted = patches.groupBy("tile").agg(F.collect_list(F.struct("patch_seq", "row", "col", "height", "width")).alias("_w"))
    joined = tiles_.select("tile", "content").join(wanted, "tile")

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for tile, content, some in frame.itertuples(index=False):
                for w in some:
                    image = decode(bytes(content), w["row"], w["col"], w["height"], w["width"])
                    if image is not None:
                        out.append((tile, w["patch_seq"], w["row"], w["col"], image))
            yield pd.DataFrame(out, columns=["tile", "patch_seq", "top", "left", "image"])

    return joined.mapInPandas(run, schema)


def rasters(spark: SparkSession, root: str, pattern: str = "*.tif") -> DataFrame:
    """Image files of any kind with their content, to go through ``windows`` (tiles that can be
    read by ranges go through ``sources.rasters``)."""
    return files(spark, root, pattern).select("path", "content", *path_parts(F.col("path")))


def images(spark: SparkSession, root: str, top: int, left: int, height: int, width: int) -> DataFrame:
    """Plain images (PNG, JPEG) below a folder, cut to a window: path, the height and width of what
    is left of it, and as pixels the bytes of red, green and blue, pixel by pixel. Images without
    three or four channels, and those that the window misses, are left out."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root).select("image.*")
    own = found.where(f"nChannels >= 3 and height > {top} and width > {left}")

    def run(frames):
        import numpy as np

        for frame in frames:
            whole = [np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels) for r in frame.itertuples()]
            cut = [x[top : top + height, left : left + width, 2::-1] for x in whole]  # stored as blue, green, red
            yield frame[["origin"]].assign(height=[x.shape[0] for x in cut], width=[x.shape[1] for x in cut], pixels=[x.tobytes() for x in cut])

    return own.mapInPandas(run, "origin string, height int, width int, pixels binary").withColumnRenamed("origin", "path")
