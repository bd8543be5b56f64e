"""Events, mosaics and tiles as tables: splits, matches and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import utm
from tessera.sources.writers import stored

WHENS = ("pre", "post")


def path_parts(path: Column) -> list[Column]:
    """event, when, mosaic and tile of ``.../event/when/mosaic/tile.tif``."""
    parts = F.split(path, "/")
    names = [F.element_at(parts, -n).alias(c) for n, c in ((4, "event"), (3, "when"), (2, "mosaic"))]
    return [*names, F.regexp_replace(F.element_at(parts, -1), r"\.tif$", "").alias("tile")]


def split_by_date(items: DataFrame, dates: DataFrame, taken: str, event: str = "event", date: str = "event_date") -> DataFrame:
    """Items of dated events with ``when``: pre before the event's day, post from it on. Items
    without a time have none."""
    dated = items.join(dates, event)
    day = F.to_date(taken)
    return dated.withColumn("when", F.when(day < F.col(date), "pre").when(day >= F.col(date), "post"))


def completeness(split: DataFrame, by: list[str]) -> DataFrame:
    """Counts of both sides and whether they add up."""
    out = split.groupBy(*by).agg(F.count_if(F.col("when") == "pre").alias("n_pre"), F.count_if(F.col("when") == "post").alias("n_post"), F.count("*").alias("n"))
    return out.withColumn("complete", F.col("n_pre") + F.col("n_post") == F.col("n"))


def select_when(rows: DataFrame, when: str | None) -> DataFrame:
    if when in (None, "None"):
        return rows
    if when not in WHENS:
        raise ValueError(f"when is pre, post or None, not {when}")
    return rows.where(F.col("when") == when)


def first_of(rows: DataFrame, column: str, value: str, wanted: str) -> str:
    """The value in a lookup table; an error without one."""
    found = rows.where(F.col(column) == value).orderBy(wanted).select(wanted).first()
    if found is None:
        raise LookupError(f"no {column} is {value}")
    return found[0]


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one table that another lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def not_done(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(done, key, "left_anti")


def matched(tiles: DataFrame) -> DataFrame:
    """(event, when, mosaic, img) of images that both sides have; an image counts once for
    each mosaic that has it."""
    images = tiles.select("event", "when", "mosaic", "img").distinct()
    both = images.groupBy("event", "img").agg(F.count_distinct("when").alias("_n")).where("_n = 2")
    return images.join(both.select("event", "img"), ["event", "img"], "left_semi").select("event", "when", "mosaic", "img")


def unmatched(tiles: DataFrame) -> DataFrame:
    images = tiles.select("event", "when", "mosaic", "img").distinct()
    return images.join(matched(tiles), ["event", "when", "mosaic", "img"], "left_anti")


def match_rate(tiles: DataFrame) -> DataFrame:
    """For each event and side, images in all mosaics, those matched, and the percentage."""
    images = tiles.select("event", "when", "mosaic", "img").distinct()
    total = images.groupBy("event", "when").agg(F.count("*").alias("n_images"))
    hits = matched(tiles).groupBy("event", "when").agg(F.count("*").alias("n_matched"))
    joined = total.join(hits, ["event", "when"], "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return joined.withColumn("percent", F.round(F.try_divide(100.0 * F.col("n_matched"), F.col("n_images")), 2))


def mosaics_of_images(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("event", "img").agg(F.sort_array(F.collect_set("mosaic")).alias("mosaics"))


def images_of_mosaics(tiles: DataFrame) -> DataFrame:
    return matched(tiles).groupBy("event", "when", "mosaic").agg(F.sort_array(F.collect_set("img")).alias("imgs"))


def has_sides(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("event").agg(F.bool_or(F.col("when") == "pre").alias("has_pre"), F.bool_or(F.col("when") == "post").alias("has_post"))


def totals(tiles: DataFrame, by: str, area: str) -> DataFrame:
    """Images and area of each value of ``by`` and, with a null there, of all."""
    return tiles.rollup(by).agg(F.count("*").alias("n_images"), F.sum(area).alias("area"), F.grouping_id().alias("level"))


def bounding_box(features: DataFrame, by: list[str], grow: float = 0.0) -> DataFrame:
    """The smallest box around each group's boxes, wider by ``grow`` in all."""
    out = features.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.withColumns({"x0": F.col("x0") - grow / 2, "y0": F.col("y0") - grow / 2, "x1": F.col("x1") + grow / 2, "y1": F.col("y1") + grow / 2})


def bounding_box_across(boxes: DataFrame, by: list[str], order: str, zone: str = "zone") -> DataFrame:
    """The smallest box around each group's boxes of several northern UTM zones, in the zone of the
    group's first box; boxes are moved by their two corners, which is not their true envelope."""
    first = boxes.groupBy(*by).agg(F.min_by(zone, order).alias("_to"))
    lon_lat = utm.box_to_lon_lat(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col(zone), F.lit(False))
    joined = boxes.join(first, by).withColumns(dict(zip(("_lon0", "_lat0", "_lon1", "_lat1"), lon_lat, strict=True)))
    moved = [c for k in "01" for c in utm.to_utm(F.col(f"_lon{k}"), F.col(f"_lat{k}"), F.col("_to"))]
    same = F.col(zone) == F.col("_to")
    placed = joined.withColumns({c: F.when(same, F.col(c)).otherwise(new) for c, new in zip(("x0", "y0", "x1", "y1"), moved, strict=True)})
    return bounding_box(placed, [*by, "_to"]).withColumnRenamed("_to", zone)


def ecdf(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(order, value, rank, share) with share 0 for the smallest and 1 for the largest; ties
    by ``order``, nulls first. Rows are dealt out and sorted by ranges of value and order, so
    that a value that very many have is split too; a range starts after the counts of those
    before it. The result doesn't depend on where the cuts lie."""
    from pyspark.sql import Window as W

    dealt = rows.select(*order, value).repartitionByRange(F.col(value), *order).sortWithinPartitions(value, *order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in its partition
    parted = stored(dealt.select(*order, value, F.spark_partition_id().alias("_part"), place.alias("_place")), "ranges")
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    ranked = parted.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_place") + 1)
    return ranked.select(*order, value, "rank", F.coalesce(F.try_divide(F.col("rank") - 1, F.col("_all") - 1), F.lit(0.0)).alias("share"))


def bucket(value: Column, bounds: list[float]) -> Column:
    """How many bounds a value reaches."""
    out = F.lit(0)
    for b in bounds:
        out += F.when(value >= b, 1).otherwise(0)
    return out


def first_match(rows: DataFrame, others: DataFrame, key: str, other_key: str, order: str) -> DataFrame:
    """Each row with its first match by ``order``; rows without one are left out."""
    named = [c for c in others.columns if c != other_key]
    first = others.groupBy(other_key).agg(F.min_by(F.struct(*named), order).alias("_first"))
    return rows.join(first, F.col(key) == F.col(other_key)).select(*rows.columns, "_first.*")


def enumerated(events: DataFrame, mosaics: DataFrame, tiles: DataFrame) -> DataFrame:
    """Events, their mosaics of both sides and those mosaics' tiles, with each tile's path."""
    out = events.join(mosaics, "event").join(tiles, ["event", "when", "mosaic"])
    return out.withColumn("path", F.concat(F.concat_ws("/", "event", "when", "mosaic", "img"), F.lit(".tif")))


def in_order(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with their place by the smallest ``order`` that they have. As many rows
    as there are events are ranked in one task."""
    from pyspark.sql import Window as W

    first = rows.groupBy(column).agg(F.min(order).alias("_first"))
    return first.select(column, F.row_number().over(W.orderBy("_first", column)).alias("place"))


def date_parts(rows: DataFrame, date: str) -> DataFrame:
    return rows.withColumns({"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)})


def files_of(rows: DataFrame, files: DataFrame, column: str, ending: str) -> DataFrame:
    """Rows with the file (name) that is called like them."""
    return rows.join(files, F.concat(F.col(column), F.lit(ending)) == F.col("name"))


def not_empty(rows: DataFrame, what: str) -> DataFrame:
    """The rows; when they are read and there are none, an error."""
    n = rows.limit(1).agg(F.count("*").alias("n")).scalar()
    none = F.raise_error(F.lit(f"there are no {what}")).cast("boolean")
    guard = rows.sparkSession.range(0, 1, 1, 1).where(F.when(n == 0, none).otherwise(F.lit(False)))
    return rows.unionByName(guard.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)))
