"""Geometries as arrays of vertices (x, y), in column expressions.

Touching counts as intersecting. A buffer is never built: being in it is a distance.

A polygon is one ring, or parts: an array of polygons, each an array of rings, the outer one and
then its holes. A point is in parts if it is in an odd number of their rings, or on one of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.boxes import Corners

VERTICES = "array<struct<x:double,y:double>>"
PARTS = f"array<array<{VERTICES}>>"


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def envelope(g: Column) -> Corners:
    xs, ys = F.transform(g, lambda v: v["x"]), F.transform(g, lambda v: v["y"])
    return Corners(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def edges(g: Column) -> Column:
    """Pairs (a, b) of vertices that follow each other."""
    n = F.size(g)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(g, i).alias("a"), F.get(g, i + 1).alias("b")))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def ring_edges(parts: Column) -> Column:
    """The edges of all rings of a polygon's parts."""
    return F.flatten(F.transform(F.flatten(parts), edges))


def parts_envelope(parts: Column) -> Corners:
    return envelope(F.flatten(F.flatten(parts)))


def parts_area(parts: Column) -> Column:
    """Area inside the outer rings without that of the holes."""
    def of(rings: Column) -> Column:
        areas = F.transform(rings, ring_area)
        return 2 * F.coalesce(F.get(areas, 0), F.lit(0.0)) - F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)

    return F.aggregate(F.transform(parts, of), F.lit(0.0), lambda a, x: a + x)


def edge_crossing(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """What an edge says of a point: 1 if a ray to the right crosses it, 0 if it doesn't, and a
    large number if the point is on it."""
    across = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    on = (across == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
    right = ((ay > y) != (by > y)) & ((across > 0) == (by > ay))
    return F.when(on, F.lit(1 << 40).cast("long")).when(right, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def ray_crossing(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 if a ray from a point to the right crosses an edge, else 0."""
    return F.when(((ay > y) != (by > y)) & (x < ax + F.try_divide((y - ay) * (bx - ax), by - ay)), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def inside(crossings: Column) -> Column:
    """Whether the sum of edge_crossing over all rings is of a point inside or on the border."""
    return (crossings >= 1 << 40) | (crossings % 2 == 1)


def in_parts(x: Column, y: Column, parts: Column) -> Column:
    """Whether a point is in a polygon's parts, borders included."""
    one = lambda a, e: a + edge_crossing(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])
    return inside(F.aggregate(ring_edges(parts), F.lit(0).cast("long"), one))


def length(g: Column) -> Column:
    return F.aggregate(edges(g), F.lit(0.0), lambda acc, e: acc + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def ring_area(g: Column) -> Column:
    """Area inside a closed ring."""
    twice = F.aggregate(edges(g), F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(twice) / 2


def edge_ratio(g: Column) -> Column:
    """The smaller quotient of a ring's first two edges."""
    side = lambda i: F.hypot(F.get(g, i + 1)["x"] - F.get(g, i)["x"], F.get(g, i + 1)["y"] - F.get(g, i)["y"])
    a, b = side(0), side(1)
    return F.least(F.try_divide(a, b), F.try_divide(b, a))


def in_ring(x: Column, y: Column, g: Column) -> Column:
    """Whether a point is inside a closed ring (an edge to its right counts as crossing)."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return spans & (x < at)

    return F.size(F.filter(edges(g), crosses)) % 2 == 1


def in_fixed_ring(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """``in_ring`` for a known ring of few corners: plain arithmetic, without arrays a row."""
    pairs = zip(corners, [*corners[1:], corners[0]], strict=True)
    return sum((ray_crossing(x, y, *(F.lit(float(v)) for v in (*a, *b))) for a, b in pairs), F.lit(0)) % 2 == 1


def segment_hits_box(a: Column, b: Column, box: Corners) -> Column:
    """Separating axes of a segment and a box."""
    cx, cy = box.center()
    ex, ey = box.width() / 2, box.height() / 2
    mx, my = (a["x"] + b["x"]) / 2 - cx, (a["y"] + b["y"]) / 2 - cy
    dx, dy = (b["x"] - a["x"]) / 2, (b["y"] - a["y"]) / 2
    return (F.abs(mx) <= ex + F.abs(dx)) & (F.abs(my) <= ey + F.abs(dy)) & (F.abs(dx * my - dy * mx) <= ex * F.abs(dy) + ey * F.abs(dx))


def line_hits_box(g: Column, box: Corners) -> Column:
    return F.exists(edges(g), lambda e: segment_hits_box(e["a"], e["b"], box))


def polygon_hits_box(g: Column, box: Corners) -> Column:
    """A ring's edge meets the box, or the box is inside the ring."""
    return line_hits_box(g, box) | in_ring(box.x0, box.y0, g)


def parts_hit_box(parts: Column, box: Corners) -> Column:
    """A ring's edge meets the box, or the box is inside the parts and not in a hole."""
    return F.exists(ring_edges(parts), lambda e: segment_hits_box(e["a"], e["b"], box)) | in_parts(box.x0, box.y0, parts)


def ring(corners: list[tuple[Column, Column]]) -> Column:
    """A closed ring of these corners."""
    return F.array(*(vertex(x, y) for x, y in [*corners, corners[0]]))


def in_patch(g: Column, left: Column, top: Column, resolution: float) -> Column:
    """Vertices in pixels of a patch with that upper left corner; pixel rows go down."""
    return F.transform(g, lambda v: vertex((v["x"] - left) / resolution, (top - v["y"]) / resolution))


def segment_hits_ring(ax: Column, ay: Column, bx: Column, by: Column, g: Column) -> Column:
    """Whether a segment meets a ring's edge or lies within the ring."""
    def turn(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def crosses(e: Column) -> Column:
        cx, cy, dx, dy = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        apart = (F.greatest(ax, bx) < F.least(cx, dx)) | (F.greatest(cx, dx) < F.least(ax, bx)) | (F.greatest(ay, by) < F.least(cy, dy)) | (F.greatest(cy, dy) < F.least(ay, by))
        both = (turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) <= 0) & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) <= 0)
        return ~apart & both

    return F.exists(edges(g), crosses) | in_ring(ax, ay, g)


def segment_distance_squared(x: Column, y: Column, e: Column) -> Column:
    """From a point to the nearest point of an edge: an end, or the foot of the
    perpendicular where that lies between them."""
    return between_squared(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])


def between_squared(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy, px, py = bx - ax, by - ay, x - ax, y - ay
    along, whole = px * dx + py * dy, dx * dx + dy * dy
    across = px * dy - py * dx
    return F.when(along <= 0, px * px + py * py).when(along >= whole, (x - bx) * (x - bx) + (y - by) * (y - by)).otherwise(across * across / whole)


def distance_squared(x: Column, y: Column, g: Column) -> Column:
    """From a point to the nearest point of a line."""
    return F.array_min(F.transform(edges(g), lambda e: segment_distance_squared(x, y, e)))


def points_along(g: Column, every: float) -> Column:
    """Points from the start on, ``every`` apart; the end is not one of them. Each edge has the
    points that fall on it, from where it starts along the line."""
    size = lambda e: F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
    starts = F.aggregate(edges(g), F.array(F.lit(0.0)), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) + size(e))))

    def on(e: Column, i: Column) -> Column:
        first, last = (F.ceil(F.get(starts, i + k) / every).cast("int") for k in (0, 1))
        t = lambda k: (k * F.lit(float(every)) - F.get(starts, i)) / size(e)
        at = lambda k: vertex(e["a"]["x"] + t(k) * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + t(k) * (e["b"]["y"] - e["a"]["y"]))
        return F.when(last > first, F.transform(F.sequence(first, last - 1), at)).otherwise(F.array().cast(VERTICES))

    return F.flatten(F.transform(edges(g), on))


def offset(g: Column, d: float) -> Column:
    """Each edge shifted by d to its left (right if negative); exact for straight lines."""
    def moved(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        n = F.hypot(dx, dy)
        nx, ny = F.coalesce(F.try_divide(-dy, n), F.lit(0.0)) * d, F.coalesce(F.try_divide(dx, n), F.lit(0.0)) * d
        return F.array(vertex(e["a"]["x"] + nx, e["a"]["y"] + ny), vertex(e["b"]["x"] + nx, e["b"]["y"] + ny))

    return F.flatten(F.transform(edges(g), moved))


def line_from_json(text: Column) -> Column:
    """The vertices of a JSON feature's line; anything malformed is an empty line."""
    kind = "struct<geometry:struct<type:string,coordinates:array<array<double>>>>"
    pairs = F.from_json(text, kind)["geometry"]["coordinates"]
    return F.coalesce(F.transform(pairs, lambda c: vertex(F.get(c, 0), F.get(c, 1))), F.array().cast(VERTICES))


def parts_from_json(kind: Column, coordinates: Column) -> Column:
    """The parts of a GeoJSON Polygon or MultiPolygon, whose coordinates are JSON text; of
    anything else, no part."""
    polygon = "array<array<array<double>>>"
    rings = lambda p: F.transform(p, lambda r: F.transform(r, lambda c: vertex(F.get(c, 0), F.get(c, 1))))
    one, many = F.from_json(coordinates, polygon), F.from_json(coordinates, f"array<{polygon}>")
    parts = F.when(kind == "Polygon", F.array(rings(one))).when(kind == "MultiPolygon", F.transform(many, rings))
    return F.coalesce(F.filter(parts, lambda p: p.isNotNull()), F.array().cast(PARTS))
