"""Rasters in long form: a row for each pixel that is set or scored; others have a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import between_squared
from tessera.operators.spatial_join import EDGE, edge_rows, near_lines

#: Later channels win where masks overlap.
PRIORITY = ("road", "tree", "building")
#: Surroundings of a pixel, as offsets of row and column.
SQUARE = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1))
CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))


def pixels_of(rows: DataFrame, values: str, width: int, keep: list[str]) -> DataFrame:
    """row, col and v of each value of an array, row after row."""
    return rows.select(*keep, F.posexplode(values).alias("_pos", "v")).select(*keep, F.floor(F.col("_pos") / width).cast("int").alias("row"), (F.col("_pos") % width).alias("col"), "v")


def positive(v: Column) -> Column:
    """A logit at or above 0; NaN is not."""
    return (v >= 0) & ~F.isnan(v)


def fold_any(pixels: DataFrame, by: list[str], frame: DataFrame | None = None) -> DataFrame:
    """Whether any mask covers a pixel; pixels of ``frame`` without one are not covered."""
    folded = pixels.groupBy(*by).agg(F.bool_or(positive(F.col("v"))).alias("covered"))
    if frame is None:
        return folded
    return frame.join(folded, by, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def fold_max(pixels: DataFrame, by: list[str], frame: DataFrame | None = None) -> DataFrame:
    """The largest logit of a pixel; -inf without any."""
    folded = pixels.groupBy(*by).agg(F.max("v").alias("v"))
    if frame is None:
        return folded
    return frame.join(folded, by, "left").withColumn("v", F.coalesce("v", F.lit(float("-inf")).cast("float")))


def on_canvas(pixels: DataFrame, top: str, left: str, height: int, width: int) -> DataFrame:
    """Patch pixels to canvas pixels, cut at the canvas's border."""
    moved = pixels.withColumns({"row": F.col(top) + F.col("row"), "col": F.col(left) + F.col("col")})
    return moved.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def blend(pixels: DataFrame, by: list[str], mode: str, order: str = "patch_seq", weight: Column | None = None) -> DataFrame:
    """One value for each canvas pixel: the last patch's (last), the largest (max), the
    weighted sum (sum), or the average with what was there, patch after patch (average)."""
    if mode == "last":
        v = F.max_by("v", order)
    elif mode == "max":
        v = F.max("v")
    elif mode == "sum":
        v = F.sum(F.col("v") * (F.lit(1.0) if weight is None else weight))
    elif mode == "average":
        sorted_ = F.array_sort(F.collect_list(F.struct(order, F.col("v").cast("double").alias("v"))))
        v = F.aggregate(F.slice(sorted_, 2, F.greatest(F.lit(1), F.size(sorted_))), F.get(sorted_, 0)["v"], lambda acc, x: (acc + x["v"]) / 2)
    else:
        raise ValueError(f"no blend mode {mode}")
    return pixels.groupBy(*by).agg(v.alias("v"))


def spline_weight(i: Column, size: int, power: int = 2) -> Column:
    """A window over 0..size-1: squared wings around a squared triangle, with mean 1."""
    tri = [1 - abs(2 * (k + 1) / (size + 1) - 1) if size % 2 else (2 * k + 1) / size if k < size // 2 else 2 - (2 * k + 1) / size for k in range(size)]
    quarter = size // 4
    outer = [(abs(2 * t) ** power) / 2 for t in tri]
    inner = [1 - (abs(2 * (t - 1)) ** power) / 2 for t in tri]
    w = [o if k < quarter or k >= size - quarter else x for k, (o, x) in enumerate(zip(outer, inner, strict=True))]
    mean = sum(w) / size
    return F.get(F.array(*(F.lit(x / mean) for x in w)), i)


def without_overlap(masks: DataFrame, by: list[str], channel: str = "channel", priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Set pixels (``by``, channel) of which a channel keeps those that no later one has too."""
    ranks = F.array(*(F.lit(p) for p in priority))
    last = masks.groupBy(*by).agg(F.max(F.array_position(ranks, F.col(channel))).alias("_rank"))
    return last.select(*by, F.get(ranks, (F.col("_rank") - 1).cast("int")).alias(channel))


def burn_lines(lines: DataFrame, geometry: str, width: float, height: int, columns: int, keep: list[str]) -> DataFrame:
    """Pixels (row, col) with their centre within ``width`` of a line. Equal edges are one,
    and only pixels near an edge's own envelope are looked at."""
    single = spread(edge_rows(lines, geometry, keep))
    low, high = lambda a, b: F.greatest(F.lit(0), F.floor(F.least(a, b) - width).cast("int")), lambda a, b, n: F.least(F.lit(n - 1), F.floor(F.greatest(a, b) + width).cast("int"))
    boxed = single.withColumns({"_r0": low("_ay", "_by"), "_r1": high("_ay", "_by", height), "_c0": low("_ax", "_bx"), "_c1": high("_ax", "_bx", columns)})
    rows = boxed.where("_r0 <= _r1 and _c0 <= _c1").withColumn("row", F.explode(F.sequence("_r0", "_r1")))
    cells = rows.withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    near = between_squared(F.col("col") + 0.5, F.col("row") + 0.5, *map(F.col, EDGE)) <= width * width
    return cells.where(near).select(*keep, "row", "col").distinct()


def spread(rows: DataFrame) -> DataFrame:
    """Over all shuffle partitions, for rows that are few but become many: adaptive
    execution would put them in as few tasks as their bytes need."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def clip_to_lines(pixels: DataFrame, lines: DataFrame, geometry: str, distance: float, keep: list[str]) -> DataFrame:
    """Set pixels within a distance of a line."""
    return near_lines(pixels, lines, F.col("col") + 0.5, F.col("row") + 0.5, geometry, distance, 64.0).select(*keep).distinct()


def neighbours(pixels: DataFrame, by: list[str], shape: tuple[tuple[int, int], ...] = SQUARE, frame: DataFrame | None = None) -> DataFrame:
    """Each pixel's surroundings of a shape, with how many set pixels each has around it (_n)
    and, as _all, how many it can have: with a frame (by, height, width), as many as are in it."""
    around = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in shape)))
    moved = pixels.select(*by, "row", "col", around.alias("_d")).select(*by, (F.col("row") + F.col("_d.r")).alias("row"), (F.col("col") + F.col("_d.c")).alias("col"))
    found = moved.groupBy(*by, "row", "col").agg(F.count("*").alias("_n"))
    if frame is None:
        return found.withColumn("_all", F.lit(len(shape)))
    inside = lambda r, c: (F.col("row") + r).between(0, F.col("height") - 1) & (F.col("col") + c).between(0, F.col("width") - 1)
    sized = frame.select(*(F.col(c).alias(f"_f{i}") for i, c in enumerate(by)), "height", "width")
    framed = found.join(sized, [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(by)]).where(inside(0, 0))
    return framed.drop(*(f"_f{i}" for i in range(len(by)))).withColumn("_all", sum((inside(r, c).cast("int") for r, c in shape), F.lit(0))).drop("height", "width")


def eroded(pixels: DataFrame, by: list[str], shape: tuple[tuple[int, int], ...] = SQUARE, frame: DataFrame | None = None) -> DataFrame:
    return neighbours(pixels, by, shape, frame).where("_n = _all").drop("_n", "_all")


def dilated(pixels: DataFrame, by: list[str], shape: tuple[tuple[int, int], ...] = SQUARE, frame: DataFrame | None = None) -> DataFrame:
    return neighbours(pixels, by, shape, frame).drop("_n", "_all")


def opened(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Distinct set pixels without what is thinner than three pixels."""
    return dilated(eroded(pixels, by), by)


def closed(pixels: DataFrame, by: list[str]) -> DataFrame:
    return eroded(dilated(pixels, by), by)


def best_mask(candidates: DataFrame, by: list[str], mask: str, score: str) -> DataFrame:
    return candidates.groupBy(*by).agg(F.max_by(mask, score).alias(mask), F.max(score).alias(score))


def on_canvas_at(pixels: DataFrame, i: str, j: str, stride: int, height: int, width: int) -> DataFrame:
    """Patch pixels to canvas pixels by the patch's row and column in the grid."""
    placed = pixels.withColumns({"_top": F.col(i) * stride, "_left": F.col(j) * stride})
    return on_canvas(placed, "_top", "_left", height, width).drop("_top", "_left")


def stacked(masks: DataFrame, by: list[str], channel: str = "channel", value: str = "covered", channels: tuple[str, ...] = PRIORITY) -> DataFrame:
    """A column for each channel of ``channels``; others, such as padding, are dropped."""
    own = masks.where(F.col(channel).isin(*channels))
    return own.groupBy(*by).agg(*(F.coalesce(F.bool_or(F.when(F.col(channel) == c, F.col(value))), F.lit(False)).alias(c) for c in channels))
