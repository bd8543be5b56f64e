"""Nearest places and polygons of several parts against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tessera.functions import geometry as g
from tessera.functions.boxes import Corners
from tessera.operators import nearest as near
from tessera.operators import spatial_join as sj
from tessera.operators import tiling

POINTS, PLACES = "id int, x double, y double", "name string, px double, py double"
INF, NAN = float("inf"), float("nan")


def slow_nearest(points, places):
    usable = [p for p in places if all(v is not None and abs(v) < INF for v in p[1:])]
    best = lambda x, y: min(((x - a) * (x - a) + (y - b) * (y - b), n) for n, a, b in usable)
    return {i: best(x, y) for i, x, y in points if all(v is not None and abs(v) < INF for v in (x, y)) and usable}


def found_nearest(spark, points, places):
    rows = near.nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(places, PLACES), "x", "y", "px", "py", ["id"], "name").collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.distance2, r.name) for r in rows}


@pytest.mark.parametrize("kind", ["even", "far", "one spot", "one line", "clusters"])
def test_nearest(spark, kind):
    r = random.Random(kind)
    spot = {
        "even": lambda k: (r.uniform(-180, 180), r.uniform(-90, 90)),
        "far": lambda k: (1e9, -1e9) if k == 5 else (r.gauss(0, 1e-3), r.gauss(0, 1e-3)),
        "one spot": lambda k: (3.0, 4.0),
        "one line": lambda k: (5.0, float(k % 300)),
        "clusters": lambda k: (k % 3 * 100 + round(r.random(), 1), k % 2 * 50 + round(r.random(), 1)),
    }[kind]
    places = [(f"p{r.randrange(10**6)}", *spot(k)) for k in range(1500)]
    points = [(i, r.uniform(-200, 200), r.uniform(-100, 100)) for i in range(200)] + [(900, -1e12, 1e12), (901, *places[7][1:])]
    assert found_nearest(spark, points, places) == slow_nearest(points, places)


def test_nearest_odd_rows(spark):
    places = [("a", None, 1.0), ("b", NAN, 1.0), ("c", 1.0, INF), ("e", 2.0, 2.0), ("d", 2.0, 2.0), (None, 9.0, 9.0)]
    points = [(1, None, 0.0), (2, 0.0, NAN), (3, INF, 0.0), (4, 1.0, 1.0), (4, 1.0, 1.0)]
    assert found_nearest(spark, points, places) == {4: (2.0, "d")}
    assert found_nearest(spark, points, []) == {} and found_nearest(spark, [], places) == {}


def test_no_point_meets_many_places(spark):
    r = random.Random(3)
    places = spark.createDataFrame([(1e9, 1e9)] + [(r.gauss(0, 1e-3), r.gauss(0, 1e-3)) for _ in range(20_000)], "px double, py double")
    tree, leaves = near.tree_of(places, "px", "py")
    assert tree.levels > 8 and leaves.groupBy("_leaf").count().agg(F.max("count")).first()[0] < 6 * near.LEAF
    points = spark.createDataFrame([(r.gauss(0, 2e-3), r.gauss(0, 2e-3)) for _ in range(300)] + [(1e6, 0.0)], "x double, y double")
    met = near.dealt(points, tree, "x", "y", True)
    assert met.groupBy("x").count().agg(F.avg("count")).first()[0] < 12


def parts(*polygons):
    return [[[{"x": float(x), "y": float(y)} for x, y in (*ring, ring[0])] for ring in polygon] for polygon in polygons]


SQUARE, HOLE, FAR = [(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (3, 6), (6, 6), (6, 3)], [(20, 0), (30, 0), (20, 10)]
SHAPES = {"holed": parts([SQUARE, HOLE]), "two": parts([SQUARE], [FAR]), "both": parts([SQUARE, HOLE], [FAR]), "none": []}


def is_in(name, x, y):
    square, hole, far = 0 <= x <= 10 and 0 <= y <= 10, 3 < x < 6 and 3 < y < 6, x >= 20 and y >= 0 and x - 20 + y <= 10
    return {"holed": square and not hole, "two": square or far, "both": square and not hole or far}[name]


def test_points_in_parts(spark):
    shapes = spark.createDataFrame([(n, p) for n, p in SHAPES.items()], f"name string, parts {g.PARTS}")
    spots = [(i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-2, 63) for y in range(-2, 23))]
    points = spark.createDataFrame(spots, "id int, x double, y double")
    expected = {(i, n) for i, x, y in spots for n in ("holed", "two", "both") if is_in(n, x, y)}
    rows = sj.points_in_parts(points, shapes, "x", "y", "parts", ["id", "name"], 7.0).collect()
    assert len(rows) == len(expected) and {(r.id, r.name) for r in rows} == expected
    plain = points.crossJoin(shapes).where(g.in_parts(F.col("x"), F.col("y"), F.col("parts"))).select("id", "name").collect()
    assert {tuple(r) for r in plain} == expected


def test_parts_measures_and_tiling(spark):
    shapes = spark.createDataFrame(list(SHAPES.items()), f"name string, parts {g.PARTS}")
    areas = {r.name: r.a for r in shapes.select("name", g.parts_area(F.col("parts")).alias("a")).collect()}
    assert areas == {"holed": 91, "two": 150, "both": 141, "none": 0}
    boxes = spark.createDataFrame([(4.0, 4.0, 5.0, 5.0), (2.0, 2.0, 4.0, 4.0), (12.0, 1.0, 19.0, 5.0), (29.0, 5.0, 31.0, 9.0), (-5.0, -5.0, 40.0, 40.0), (21.0, 1.0, 22.0, 2.0)], "x0 double, y0 double, x1 double, y1 double")
    hit = boxes.crossJoin(shapes.where("name = 'both'")).where(g.parts_hit_box(F.col("parts"), Corners.named())).collect()
    assert {(r.x0, r.y0) for r in hit} == {(2.0, 2.0), (-5.0, -5.0), (21.0, 1.0)}
    tiles = shapes.where("name = 'holed'").select("name", "parts", *g.parts_envelope(F.col("parts")).columns())
    cells = {(r.i, r.j) for r in tiling.grid(tiles, 1, 1, "parts").collect()}
    assert cells == {(i, j) for i in range(10) for j in range(10)} - {(4, 4)}
    drawn = tiling.random_patches(tiles, 0.5, 300, 5, "name", ("parts",)).collect()
    assert len(drawn) == 300 and all(is_in("holed", (r.px0 + r.px1) / 2, (r.py0 + r.py1) / 2) for r in drawn)


def test_parts_from_json(spark):
    texts = [("Polygon", "[[[0,0],[1,0],[0,1],[0,0]]]"), ("MultiPolygon", "[[[[0,0],[1,0],[0,1],[0,0]],[[0,0],[0.1,0],[0,0.1],[0,0]]],[[[5,5],[6,5],[5,6],[5,5]]]]"), ("Point", "[1,2]"), ("Polygon", "broken"), (None, None)]
    rows = spark.createDataFrame(texts, "kind string, text string").select(g.parts_from_json(F.col("kind"), F.col("text")).alias("p")).collect()
    assert [[len(p) for p in r.p] for r in rows] == [[1], [2, 1], [], [], []]


def test_plain_images_are_cut(spark, tmp_path):
    import struct
    import zlib

    from tessera.sources import readers

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(h, w, pixel):
        lines = b"".join(b"\0" + b"".join(bytes(pixel(y, x)) for x in range(w)) for y in range(h))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.png").write_bytes(png(5, 7, lambda y, x: (y, x, 9)))
    (tmp_path / "two.png").write_bytes(png(2, 2, lambda y, x: (1, 2, 3)))
    (tmp_path / "no.png").write_bytes(b"no image")
    rows = readers.images(spark, str(tmp_path), 3, 2, 600, 4).collect()
    assert [(r.path.rpartition("/")[2], r.height, r.width, list(r.pixels)) for r in rows] == [("one.png", 2, 4, [v for y in (3, 4) for x in range(2, 6) for v in (y, x, 9)])]


def test_an_empty_overlap_is_an_error_when_it_is_read(spark):
    from tessera.operators import catalog

    rows = spark.range(3).withColumn("v", F.col("id") * 2)
    assert sorted(tuple(r) for r in catalog.not_empty(rows, "rows").collect()) == [(0, 0), (1, 2), (2, 4)]
    nothing = catalog.not_empty(rows.where("id > 7"), "large rows")
    with pytest.raises(Exception, match="there are no large rows"):
        nothing.collect()


def ring_of(x, y, s):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]


def test_equal_keys_and_equal_shapes(spark):
    """Two rings of a key that both have a point are one pair; what many keys share is expanded."""
    polygons = spark.createDataFrame([(k, ring_of(x, 0, 10)) for k, x in (("a", 0), ("a", 2), ("b", 0), ("c", 0), ("d", 50))], f"name string, ring {g.VERTICES}")
    points = spark.createDataFrame([(i, 5.0, 5.0) for i in range(40)] + [(1, 52.0, 1.0), (90, 11.0, 1.0), (91, None, 1.0)], "id int, x double, y double")
    expected = sorted([(i, n) for i in range(40) for n in "abc"] + [(1, "d"), (90, "a")])
    assert sorted(tuple(r) for r in sj.points_in_rings(points, polygons, "x", "y", "ring", ["id", "name"], size=10).collect()) == expected
    parted = polygons.withColumn("parts", F.array(F.array("ring"))).drop("ring")
    assert sorted(tuple(r) for r in sj.points_in_parts(points, parted, "x", "y", "parts", ["id", "name"], 7.0).collect()) == expected


def lines_of(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(i, line((0, 0), (10, 10))) for i in range(30)] + [(30, line((20, 0), (30, 0), (30, 5))), (30, line((0, 1), (5, 6))), (None, line((0, 0), (1, 1))), (31, None)]
    return spark.createDataFrame(rows, f"id int, g {g.VERTICES}")


def test_lines_are_counted_by_shape(spark):
    boxes = spark.createDataFrame([(q, x, y, x + 4, y + 4) for q, x, y in (("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 28.0, 3.0), ("d", 6.0, 0.0), ("e", 2.0, 4.5))], "q string, x0 double, y0 double, x1 double, y1 double")
    rows = sj.lines_per_box(boxes, lines_of(spark), ("x0", "y0", "x1", "y1"), "g", ["q"], "id", 4).collect()
    assert {r.q: r.n_lines for r in rows} == {"a": 31, "b": 31, "c": 1, "e": 31}


def test_lines_and_polygons_by_shape(spark):
    polygons = spark.createDataFrame([(k, ring_of(x, y, 4)) for k, x, y in (("a", 0, 0), ("b", 0, 0), ("c", 28, 3), ("c", 22, -1), ("d", 6, 0))], f"name string, ring {g.VERTICES}")
    rows = sj.lines_and_polygons(polygons, lines_of(spark).where("id is not null"), "ring", "g", ["id", "name"], 4).collect()
    assert sorted(tuple(r) for r in rows) == sorted([(i, n) for i in range(31) for n in "ab"] + [(30, "c")])


def test_tiles_of_many_patches_in_pieces(spark, monkeypatch):
    """Patches of a polygon as by testing each; tiles without a polygon or its edges have none."""
    rows = [("a", parts([SQUARE, HOLE], [FAR]), 0.0, 0.0, 30.0, 10.0), ("b", parts([FAR]), 19.5, -1.0, 31.0, 12.0), ("none", [], 0.0, 0.0, 9.0, 9.0), ("null", None, 0.0, 0.0, 9.0, 9.0)]
    tiles = spark.createDataFrame(rows, f"name string, parts {g.PARTS}, x0 double, y0 double, x1 double, y1 double")
    monkeypatch.setattr(tiling, "AT_ONCE", 40)
    monkeypatch.setattr(tiling, "FEW", 700)
    made = tiling.grid(tiles, 0.7, 0.5, "parts")
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()  # edges are made once a tile
    plain = tiling.grid(tiles, 0.7, 0.5).where(g.parts_hit_box(F.col("parts"), Corners.named("px0", "py0", "px1", "py1")))
    columns = ["name", "patch_seq", "i", "j", "px0", "py0", "px1", "py1"]
    found = sorted(tuple(r) for r in made.select(*columns).collect())
    assert found == sorted(tuple(r) for r in plain.select(*columns).collect()) and {r[0] for r in found} == {"a", "b"}
    rings = tiles.where("name = 'b'").withColumn("parts", F.col("parts")[0][0])
    ringed = tiling.grid(rings, 0.7, 0.5).where(g.polygon_hits_box(F.col("parts"), Corners.named("px0", "py0", "px1", "py1")))
    assert sorted(r.patch_seq for r in tiling.grid(rings, 0.7, 0.5, "parts").collect()) == sorted(r.patch_seq for r in ringed.collect())


def test_a_fixed_ring(spark):
    """As in_ring, borders too, without arrays in the plan."""
    corners = [(0.0, 0.0), (10.0, 1.0), (9.0, 8.0), (5.0, 4.0), (0.0, 8.0)]
    spots = spark.range(24 * 24).selectExpr("(id % 24 - 4) / 2D x", "(id div 24 - 4) / 2D y")
    ring = g.ring([(F.lit(a), F.lit(b)) for a, b in corners])
    both = spots.select(g.in_ring(F.col("x"), F.col("y"), ring).alias("a"), g.in_fixed_ring(F.col("x"), F.col("y"), corners).alias("b"))
    assert both.where("a <> b or b is null").count() == 0 and 0 < both.where("b").count() < 24 * 24
    assert "lambda" not in both.select("b")._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_looks_once_for_points_at_one_position(spark, monkeypatch):
    """Each point met all places of its leaves by itself before, a row for each."""
    asked, real = [], near.dealt

    def dealt(rows, tree, x, y, to_all):
        if to_all:
            asked.append(rows.count())
        return real(rows, tree, x, y, to_all)

    monkeypatch.setattr(near, "dealt", dealt)
    points = [(i, float(i % 3), 1.0) for i in range(300)]
    places = [(f"p{k:03}", k % 40 / 4.0, k // 40 / 4.0) for k in range(400)]
    assert found_nearest(spark, points, places) == slow_nearest(points, places) and asked == [3]


def test_keys_are_grouped_once_and_without_their_shapes(spark):
    """Many keys with few shapes: what is dealt out by key is a number, and only once."""
    rows = spark.range(300).selectExpr("id % 100 k", "array(named_struct('x', double(id % 3), 'y', 0D), named_struct('x', 1D, 'y', double(id % 2))) shape")
    rows = rows.unionByName(spark.createDataFrame([(5, None), (7000, None)], "k long, shape array<struct<x: double, y: double>>"))
    keys, kinds = sj.numbered(rows, ["k"], F.col("shape"), "n")
    assert "collect_set" not in keys._jdf.queryExecution().optimizedPlan().toString()
    found = keys.join(kinds, "n").selectExpr("k", "_shape")
    assert found.exceptAll(rows.where("shape is not null").selectExpr("k", "shape").distinct()).count() == 0
    assert found.count() == rows.where("shape is not null").distinct().count() and kinds.select("n").distinct().count() < 10
