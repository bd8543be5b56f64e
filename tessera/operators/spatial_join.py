"""Joins on overlap, as equi-joins on grid cells.

A plain overlap predicate would be a nested loop. Each box is put in the cells of a grid that
suits its size, so that it touches four cells at most, and in those of the coarser grids that
the other side has boxes in. A pair meets in the coarser grid of the two, in each cell that
both touch; it is kept in one of them, the one with the lower left corner of what they share.
No step grows with the product of the sides, however large single boxes are.

Where the largest size of either side's boxes is known, the smaller boxes stay whole: each is in
the cell of its lower left corner, under one number, and the larger ones look where such corners
can be.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.boxes import Corners
from tessera.functions.geometry import between_squared, edge_crossing, edges, envelope, inside, parts_envelope, ray_crossing, ring_edges, segment_hits_box, segment_hits_ring, vertex
from tessera.operators import covering

CELL = 400.0
EDGE = ("_ax", "_ay", "_bx", "_by")
OUTER = ("_px0", "_py0", "_px1", "_py1")


def level_of(box: Corners, cell: float) -> Column:
    """The finest grid, of cells twice as large at each level, with cells as large as the box."""
    widest = F.greatest(box.width(), box.height()) / cell
    return F.when(widest <= 1, 0).otherwise(F.ceil(F.log2(widest)).cast("int"))


def level_for(size: float, cell: float) -> int:
    """The same for boxes of that size at most."""
    return math.ceil(math.log2(size / cell)) if size > cell else 0


def leveled(rows: DataFrame, box: Corners, cell: float, size: float | None, level: str) -> DataFrame:
    """With each box's grid. Boxes known to be no larger than ``size`` have one grid."""
    if size is None:
        return rows.withColumn(level, level_of(box, cell))
    return rows.withColumn(level, F.lit(level_for(size, cell)))


def celled(rows: DataFrame, box: Corners, cell: float, level: str, other: Column) -> DataFrame:
    """A row for each cell that a box touches, in its own grid and the coarser ones of ``other``,
    the levels of the other side."""
    at_level = rows.withColumn("_others", other).withColumn("_level", F.explode(F.array_union(F.array(level), F.filter("_others", lambda x: x > F.col(level)))))
    width = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    at = lambda c: F.floor(c / width)
    xs = at_level.withColumn("_cx", F.explode(F.sequence(at(box.x0), at(box.x1))))
    return xs.withColumn("_cy", F.explode(F.sequence(at(box.y0), at(box.y1))))


def overlap_join(left: DataFrame, right: DataFrame, a: Corners, b: Corners, cell: float = CELL, how: str = "inner", size_a: float | None = None, size_b: float | None = None) -> DataFrame:
    """Pairs of rows whose boxes have common points. The sides' columns need different
    names. Boxes with a null corner meet nothing. ``size_a`` and ``size_b``: what no box of a
    side is wider or higher than, if that is known; else the side is read once more for the
    sizes that it has, within the same job."""
    if size_a is not None and size_b is not None and how == "inner":
        met = corner_join(left, right, a, b, size_a, size_b) if size_a >= size_b else corner_join(right, left, b, a, size_b, size_a)
        return met.select(*left.columns, *right.columns)
    sides = [leveled(left, a, cell, size_a, "_la"), leveled(right, b, cell, size_b, "_lb")]
    levels = [F.array(F.lit(level_for(size, cell))) if size is not None else rows.agg(F.collect_set(level)).scalar() for rows, size, level in zip(sides, (size_a, size_b), ("_la", "_lb"), strict=True)]
    one = celled(sides[0], a, cell, "_la", levels[1]).withColumnsRenamed({"_level": "_level_a", "_cx": "_cx_a", "_cy": "_cy_a"})
    two = celled(sides[1], b, cell, "_lb", levels[0])
    width = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    here = (F.col("_cx") == F.floor(F.greatest(a.x0, b.x0) / width)) & (F.col("_cy") == F.floor(F.greatest(a.y0, b.y0) / width))
    same = (F.col("_level_a") == F.col("_level")) & (F.col("_cx_a") == F.col("_cx")) & (F.col("_cy_a") == F.col("_cy"))
    met = one.join(two, same & (F.col("_level") == F.greatest("_la", "_lb")) & here & a.overlaps(b), how)
    return met.select(*left.columns, *right.columns)


def corner_join(large: DataFrame, small: DataFrame, a: Corners, b: Corners, size_a: float, size_b: float) -> DataFrame:
    """Pairs with common points, of boxes that are no larger than those sizes. Cells of a third of
    the larger size leave few pairs to compare."""
    width = float(max(size_a / 3, size_b)) or 1.0
    at = lambda c: F.floor(c / width)
    key = lambda x, y: x * F.lit(1 << 32) + y
    spread = large.withColumn("_cx", F.explode(F.sequence(at(a.x0 - size_b), at(a.x1)))).withColumn("_cy", F.explode(F.sequence(at(a.y0 - size_b), at(a.y1))))
    spread = spread.withColumn("_cell", key(F.col("_cx"), F.col("_cy"))).drop("_cy")
    whole = small.where(b.x0.isNotNull() & b.y0.isNotNull()).withColumn("_spot", key(at(b.x0), at(b.y0)))
    return spread.join(whole, (F.col("_cell") == F.col("_spot")) & a.overlaps(b) & (F.abs(F.col("_cx") - at(b.x0)) < 1))


def counts_of(patches: DataFrame, features: DataFrame, a: Corners, b: Corners, by: list[str], size: float | None = None, size_b: float | None = None) -> DataFrame:
    """How many features each patch overlaps, 0 included. Patches are ``size`` wide and high, and
    features no more than ``size_b``, if known."""
    met = overlap_join(patches, features, a, b, size or CELL, size_a=size, size_b=size_b).groupBy(*by).agg(F.count("*").alias("n_boxes"))
    return patches.select(*by).join(met, by, "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))


def without_covered(boxes: DataFrame, by: str, score: str, share: float, cell: float = CELL / 4) -> DataFrame:
    """Distinct boxes (``by``, x0, y0, x1, y1, ``score``) but those with a box of the same kind
    that has a better score (or the same and larger corners) and shares more than a part of
    their union. Boxes with a null among kind and corners stay and cover nothing."""
    if not 0 < share < 1:
        raise ValueError("a share is between 0 and 1")
    a = Corners.named()
    widest = F.greatest(F.abs(a.width()), F.abs(a.height())).cast("double")
    level = lambda size: F.when(size <= cell, 0).otherwise(F.ceil(F.log2(size / cell))).cast("int")
    known = F.coalesce(F.abs(a.x0 + a.y0 + a.x1 + a.y1) < float("inf"), F.lit(False)) & F.col(by).isNotNull()
    levels = F.sequence(level(widest * (share * (1 - 1e-9))), level(widest * (1 + 1e-9) / share))
    spread = boxes.withColumn("_level", F.explode(F.when(known, levels).otherwise(F.array(F.lit(-1)))))
    cells = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    width = cells * covering.BLOCK
    own, any_of = F.col("_level") == level(widest), F.pmod(F.xxhash64(*boxes.columns), F.lit(4096))
    for axis, c, o in (("_bx", a.x0, a.x1), ("_by", a.y0, a.y1)):
        low, high = F.least(c, o).cast("double"), F.greatest(c, o).cast("double")
        slack = (cells + F.abs(low) + F.abs(high)) * 2e-9
        first, last = low - F.least(cells, (high - low) / share) * (1 - share) - slack, high - (high - low) * share + slack
        blocks = F.sequence(F.floor(first / width), F.greatest(F.floor(first / width), F.floor(last / width)))
        spread = spread.withColumn(axis, F.explode(F.when(known, blocks).otherwise(F.array(any_of))))
        own = own & (F.col(axis) == F.floor(low / width))
    dealt = spread.withColumn("_own", own | (F.col("_level") < 0))
    return dealt.groupBy(by, "_level", "_bx", "_by").applyInArrow(covering.uncovered(score, share, float(cell)), boxes.schema)


def lines_in_boxes(boxes: DataFrame, lines: DataFrame, a: Corners, geometry: str, size: float | None = None) -> DataFrame:
    """Rows of both sides (lines without their geometry), once for each edge that truly meets a
    box. ``size``: of all boxes, if known."""
    e = edge_rows(lines, geometry, [c for c in lines.columns if c != geometry])
    ax, ay, bx, by = map(F.col, EDGE)
    met = overlap_join(boxes, e, a, Corners(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)), size or CELL, size_a=size)
    return met.where(segment_hits_box(vertex(ax, ay), vertex(bx, by), a)).drop(*EDGE)


def overlap_join_in_time(left: DataFrame, right: DataFrame, a: Corners, b: Corners, at: tuple[str, str], bt: tuple[str, str], cell: float = CELL, size: float | None = None) -> DataFrame:
    """Pairs whose boxes and whose times, ends included, have something in common, with that
    time as mint and maxt. ``size``: of all boxes, if known."""
    met = overlap_join(left, right, a, b, cell, size_a=size, size_b=size).where((F.col(at[0]) <= F.col(bt[1])) & (F.col(bt[0]) <= F.col(at[1])))
    return met.withColumns({"mint": F.greatest(at[0], bt[0]), "maxt": F.least(at[1], bt[1])})


def lines_in_polygons(polygons: DataFrame, lines: DataFrame, ring: str, geometry: str, size: float | None = None) -> DataFrame:
    """Rows of both sides, once for each edge of a line that meets a polygon, its border
    included. ``size``: of all polygons, if known."""
    e = edge_rows(lines, geometry, [c for c in lines.columns if c != geometry])
    ax, ay, bx, by = map(F.col, EDGE)
    shaped = polygons.select("*", *envelope(F.col(ring)).columns("_px0", "_py0", "_px1", "_py1"))
    outer = Corners.named("_px0", "_py0", "_px1", "_py1")
    met = overlap_join(shaped, e, outer, Corners(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)), size or CELL, size_a=size)
    return met.where(segment_hits_ring(ax, ay, bx, by, F.col(ring))).drop(*EDGE, "_px0", "_py0", "_px1", "_py1")


def numbered(rows: DataFrame, by: list[str], shape: Column, number: str) -> tuple[DataFrame, DataFrame]:
    """``by`` and a number for the shapes of rows with equal ``by``, and each number's shapes (as
    _shape): what many keys have in common is looked at once. Shapes have numbers of their own first,
    so that keys are grouped, once, without them. The numbers are written, so that they stay the same."""
    from tessera.sources.writers import stored

    flat = rows.select(*by, shape.alias("_shape"))
    single = stored(flat.select("_shape").distinct().withColumn("_one", F.monotonically_increasing_id()), "shapes")
    own = flat.join(single, "_shape").groupBy(*by).agg(F.array_sort(F.collect_set("_one")).alias("_ones"))  # mostly one a key
    own = stored(own, "shapes-of-keys")
    kinds = stored(own.select("_ones").distinct().withColumn(number, F.monotonically_increasing_id()), "kinds")
    shapes = kinds.select(number, F.explode("_ones").alias("_one")).join(single, "_one")
    return own.join(kinds, "_ones").select(*by, number), shapes.select(number, "_shape")


def expanded(left: DataFrame, right: DataFrame, met: DataFrame) -> DataFrame:
    """From pairs of numbers (_na, _nb) to the keys that have them; distinct, as those are."""
    return left.join(met.select("_na", "_nb").distinct(), "_na").join(right, "_nb").drop("_na", "_nb")


def points_in_parts(points: DataFrame, polygons: DataFrame, x: str, y: str, parts: str, by: list[str], cell: float = CELL, size: float | None = None) -> DataFrame:
    """Distinct ``by`` (columns of both sides that tell points and polygons apart) of points in
    the parts of a polygon, borders included. ``size``: of all polygons, if known."""
    return points_inside(points, polygons, x, y, parts, by, cell, size, ring_edges, parts_envelope, edge_crossing, inside)


def points_in_rings(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, by: list[str], cell: float = CELL, size: float | None = None) -> DataFrame:
    """The same for polygons of one ring, with borders as in ``in_ring``."""
    return points_inside(points, polygons, x, y, ring, by, cell, size, edges, envelope, ray_crossing, lambda n: n % 2 == 1)


def points_inside(points: DataFrame, polygons: DataFrame, x: str, y: str, shape: str, by: list[str], cell: float, size: float | None, edges_of: Callable, around: Callable, crossing: Callable[..., Column], within: Callable[[Column], Column]) -> DataFrame:
    """Distinct places meet distinct polygons, whose edges' crossings are summed where a pair is
    made; then the pairs get their keys. Polygons aren't sent whole to all tasks."""
    left, spots = numbered(points, [c for c in points.columns if c in by], F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "_na")
    right, kinds = numbered(polygons, [c for c in polygons.columns if c in by], F.col(shape), "_nb")
    spots = spots.select("_na", F.col("_shape.x").alias("_x"), F.col("_shape.y").alias("_y"))
    outline = kinds.select("_nb", edges_of(F.col("_shape")).alias("_edges"), *around(F.col("_shape")).columns(*OUTER)).hint("merge")
    x_, y_ = F.col("_x"), F.col("_y")
    met = overlap_join(spots, outline, Corners(x_, y_, x_, y_), Corners.named(*OUTER), cell, size_a=0, size_b=size)
    said = F.aggregate("_edges", F.lit(0).cast("long"), lambda n, e: n + crossing(x_, y_, *(e[p][c] for p in "ab" for c in "xy")))
    return expanded(left, right, met.where(within(said))).select(*by)


def lines_per_box(boxes: DataFrame, lines: DataFrame, corners: tuple[str, str, str, str], geometry: str, by: list[str], key: str, size: float | None = None) -> DataFrame:
    """``by`` of boxes and, as n_lines, how many different ``key`` of lines truly meet one of their
    boxes; those that none meets are left out. Equal lines are counted, not listed: keys with the
    same lines have one number."""
    left, spots = numbered(boxes, by, F.struct(*(F.col(c).cast("double").alias(p) for c, p in zip(corners, OUTER, strict=True))), "_na")
    right, kinds = numbered(lines.where(F.col(key).isNotNull()), [key], F.col(geometry), "_nb")
    met = lines_in_boxes(spots.select("_na", "_shape.*"), kinds, Corners.named(*OUTER), "_shape", size).select("_na", "_nb").distinct()
    n = met.join(right.groupBy("_nb").agg(F.count("*").alias("_n")), "_nb").groupBy("_na").agg(F.sum("_n").alias("n_lines"))
    return left.join(n, "_na").select(*by, "n_lines")


def lines_and_polygons(polygons: DataFrame, lines: DataFrame, ring: str, geometry: str, by: list[str], size: float | None = None) -> DataFrame:
    """Distinct ``by`` (columns of both sides) of lines that meet a polygon, its border included.
    ``size``: of all polygons, if known."""
    left, rings = numbered(polygons, [c for c in polygons.columns if c in by], F.col(ring), "_na")
    right, kinds = numbered(lines, [c for c in lines.columns if c in by], F.col(geometry), "_nb")
    met = lines_in_polygons(rings.withColumnRenamed("_shape", "_ring"), kinds, "_ring", "_shape", size)
    return expanded(left, right, met).select(*by)


def edge_rows(lines: DataFrame, geometry: str, keep: list[str]) -> DataFrame:
    """The distinct edges of lines: ``keep`` and the coordinates EDGE."""
    single = lines.select(*keep, F.explode(edges(F.col(geometry))).alias("_e"))
    return single.select(*keep, *(F.col(f"_e.{p}.{c}").alias(f"_{p}{c}") for p in "ab" for c in "xy")).distinct()


def near_lines(points: DataFrame, lines: DataFrame, x: Column, y: Column, geometry: str, distance: float, cell: float) -> DataFrame:
    """Rows of ``points``, once for each edge within a distance. Edges are joined one by one,
    so that what a pair costs is arithmetic on eight numbers."""
    e = edge_rows(lines, geometry, [])
    ax, ay, bx, by = map(F.col, EDGE)
    around = Corners(x - distance, y - distance, x + distance, y + distance)
    met = overlap_join(points, e, around, Corners(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)), cell)
    return met.where(between_squared(x, y, ax, ay, bx, by) <= distance * distance).select(*points.columns)


def beyond_lines(points: DataFrame, lines: DataFrame, x: str, y: str, key: list[str], geometry: str, distance: float) -> DataFrame:
    """Points farther than a distance from every line."""
    near = near_lines(points, lines, F.col(x), F.col(y), geometry, distance, max(CELL / 8, 2 * distance))
    return points.join(near.select(*key).distinct(), key, "left_anti")
