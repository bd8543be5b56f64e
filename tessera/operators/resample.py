"""Bringing images to another size, as joins of pixels with weights.

A new pixel is a weighted mean of those below it: along rows first, then along columns. Weights
fall linearly with the distance from its centre and reach as far as a pixel, or, where an image
gets smaller, as far as a new pixel. Bytes stay bytes: weights are whole numbers of 2^-22 and each
of the two steps is rounded, which makes the result the same in whatever order it is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: bits of a weight, of the usual arithmetic of byte images.
BITS = 22


def taps(sizes: DataFrame) -> DataFrame:
    """(old, new, to, at, w): for each distinct pair of sizes (old, new) the pixels ``at`` that a
    new pixel ``to`` is made of, and their weights."""
    pairs = sizes.select(F.col("old").cast("int"), F.col("new").cast("int")).where("old > 0 and new > 0").distinct()
    to = pairs.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("new") - 1)))
    scale = F.col("old") / F.col("new")
    reach = F.greatest(F.lit(1.0), scale)
    centre = (F.col("to") + 0.5) * scale
    first = F.greatest(F.lit(0), F.floor(centre - reach + 0.5).cast("int"))
    last = F.least(F.col("old"), F.floor(centre + reach + 0.5).cast("int")) - 1
    near = lambda i: F.greatest(F.lit(0.0), 1 - F.abs((i - centre + 0.5) / reach))
    at = F.sequence(first, last)
    whole = to.withColumn("_sum", F.aggregate(at, F.lit(0.0), lambda a, i: a + near(i))).withColumn("at", F.explode(at))
    weight = F.floor(near(F.col("at")) / F.col("_sum") * (1 << BITS) + 0.5)
    return whole.select("old", "new", "to", "at", weight.alias("w")).where("w <> 0")


def rounded(sum_: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(sum_ + (1 << BITS - 1), BITS))).cast("int")


def along(pixels: DataFrame, by: list[str], axis: str, other: str, old: str, new: str) -> DataFrame:
    """Pixels of an axis of ``old`` brought to ``new`` ones."""
    t = taps(pixels.select(F.col(old).alias("old"), F.col(new).alias("new"))).withColumnsRenamed({"old": "_old", "new": "_new"})
    met = pixels.join(t, (F.col(old) == F.col("_old")) & (F.col(new) == F.col("_new")) & (F.col(axis) == F.col("at")))
    return met.groupBy(*by, other, F.col("to").alias(axis)).agg(rounded(F.sum(F.col("v") * F.col("w"))).alias("v"))


def resized(pixels: DataFrame, by: list[str], frame: DataFrame) -> DataFrame:
    """(by, row, col, v) of images of bytes at a new size. ``pixels`` has all pixels of an image,
    ``frame`` (by, height, width, new_height, new_width) a row for each."""
    sized = pixels.select(*by, "row", "col", F.col("v").cast("long").alias("v")).join(frame, by)
    rest = ["height", "new_height"]
    across = along(sized, [*by, *rest], "col", "row", "width", "new_width")
    return along(across, by, "row", "col", "height", "new_height").select(*by, "row", "col", "v")
