"""Small cases with known results."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from tessera.functions import geometry as g
from tessera.functions import utm
from tessera.functions.boxes import Corners, edge_ratio_over
from tessera.operators import catalog, raster, tiling
from tessera.operators import spatial_join as sj
from tessera.plans import infer
from tessera.sources import readers, writers
from tessera.streaming import arrivals


def boxes(spark, rows, prefix):
    names = ["id", "x0", "y0", "x1", "y1"]
    return spark.createDataFrame(rows, ", ".join(f"{prefix}{n} {'int' if n == 'id' else 'double'}" for n in names))


def named(prefix):
    return Corners.named(*(f"{prefix}{n}" for n in ("x0", "y0", "x1", "y1")))


@pytest.mark.parametrize(
    ("box", "meets"),
    [((20, 20, 30, 30), False), ((10, 0, 20, 10), True), ((10, 10, 20, 20), True), ((2, 2, 3, 3), True), ((0, 0, 10, 10), True)],
)
def test_overlap(spark, box, meets):
    one, two = boxes(spark, [(1, 0.0, 0.0, 10.0, 10.0)], "a"), boxes(spark, [(2, *map(float, box))], "b")
    assert sj.overlap_join(one, two, named("a"), named("b"), cell=4).count() == int(meets)


def test_overlap_join_is_the_nested_loop(spark):
    r = random.Random(5)

    def some(n, wide):
        out = []
        for i in range(n):
            x, y, w = r.uniform(-500, 500), r.uniform(-500, 500), r.choice([0.0, 1.0, 30.0, wide])
            out.append((i, x, y, x + w, y + r.uniform(0, w)))
        return out

    one, two = boxes(spark, some(150, 900.0), "a"), boxes(spark, some(150, 2500.0), "b")
    fast = {(x.aid, x.bid) for x in sj.overlap_join(one, two, named("a"), named("b"), cell=50).collect()}
    slow = [(x.aid, x.bid) for x in one.join(two, named("a").overlaps(named("b"))).collect()]
    assert fast == set(slow)
    assert sj.overlap_join(one, two, named("a"), named("b"), cell=50).count() == len(slow)


def test_overlap_join_has_no_nested_loop(spark):
    one, two = boxes(spark, [(1, 0.0, 0.0, 10.0, 10.0)], "a"), boxes(spark, [(2, 0.0, 0.0, 1.0, 1.0)], "b")
    plan = sj.overlap_join(one, two, named("a"), named("b"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_join_of_nothing(spark):
    one, two = boxes(spark, [], "a"), boxes(spark, [(1, None, 0.0, 1.0, 1.0)], "b")
    assert sj.overlap_join(one, two, named("a"), named("b")).count() == 0
    assert sj.overlap_join(two, boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)], "a"), named("b"), named("a")).count() == 0


def test_box_without_height_fails_the_ratio(spark):
    row = spark.range(1).select(edge_ratio_over(F.lit(3.0), F.lit(0.0), 0.1).alias("a"), edge_ratio_over(F.lit(2.0), F.lit(2.0), 0.5).alias("b")).first()
    assert (row.a, row.b) == (False, True)


def test_blend(spark):
    """Two patches on a canvas of 8 x 8: of 2 at (0, 0) and of 4 at (0, 2)."""
    rows = [(p, r, c, top, left, float(v)) for p, v, top, left in ((0, 2, 0, 0), (1, 4, 0, 2)) for r in range(4) for c in range(4)]
    pixels = spark.createDataFrame(rows, "patch_seq int, row int, col int, top int, left int, v float")
    canvas = raster.on_canvas(pixels, "top", "left", 8, 8)
    value = lambda mode: {(x.row, x.col): x.v for x in raster.blend(canvas, ["row", "col"], mode).collect()}
    last, most, mean, total = value("last"), value("max"), value("average"), value("sum")
    assert len(last) == 24 and last[0, 1] == 2 and last[0, 2] == 4
    assert most == last and mean[0, 2] == 3 and total[0, 3] == 6
    with pytest.raises(ValueError):
        raster.blend(canvas, ["row", "col"], "no")


def test_last_channel_wins(spark):
    masks = spark.createDataFrame([(0, "road"), (0, "tree"), (0, "building"), (1, "road"), (1, "tree"), (2, "road")], "p int, channel string")
    assert {tuple(r) for r in raster.without_overlap(masks, ["p"]).collect()} == {(0, "building"), (1, "tree"), (2, "road")}


def test_opening_and_closing(spark):
    square = [(0, r, c) for r in range(5) for c in range(5)]
    m = spark.createDataFrame([*square, (0, 2, 9)], "image int, row int, col int")
    assert {(r.row, r.col) for r in raster.opened(m, ["image"]).collect()} == {(r, c) for _, r, c in square}
    holed = spark.createDataFrame([s for s in square if s != (0, 2, 2)], "image int, row int, col int")
    assert {(r.row, r.col) for r in raster.closed(holed, ["image"]).collect()} == {(r, c) for _, r, c in square}


def test_grid_covers_the_tile(spark):
    tile = spark.createDataFrame([("t", 0.0, 0.0, 1000.0, 620.0)], "tile string, x0 double, y0 double, x1 double, y1 double")
    rows = tiling.grid(tile, 600, 400).collect()
    assert [(r.i, r.j) for r in sorted(rows, key=lambda r: r.patch_seq)] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert max(r.px1 for r in rows) >= 1000 and max(r.py1 for r in rows) >= 620
    batched = tiling.batches(tiling.grid(tile, 600, 400), 3, ["tile"])
    assert [r["count"] for r in batched.groupBy("batch_ix").count().orderBy("batch_ix").collect()] == [3, 1]
    assert tiling.batch_count(4, 3) == 2


def test_tile_size_must_be_whole(spark):
    assert spark.range(1).select(tiling.tile_pixels(F.lit(600.0), 0.5).alias("n")).first().n == 1200
    with pytest.raises(Exception, match="no whole number"):
        spark.range(1).select(tiling.tile_pixels(F.lit(600.1), 0.5)).collect()


def test_geometry(spark):
    line = F.array(*(g.vertex(F.lit(x), F.lit(y)) for x, y in ((0, 0), (30, 40), (30, 0))))
    ring = F.array(*(g.vertex(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))))
    box = lambda *c: Corners(*(F.lit(float(x)) for x in c))
    r = spark.range(1).select(
        g.length(line).alias("n"), g.ring_area(ring).alias("a"), g.edge_ratio(ring).alias("e"), g.in_ring(F.lit(1.0), F.lit(1.0), ring).alias("i"), g.in_ring(F.lit(5.0), F.lit(1.0), ring).alias("o"),
        g.line_hits_box(line, box(10, 0, 14, 10)).alias("miss"), g.line_hits_box(line, box(14, 20, 16, 22)).alias("hit"), g.polygon_hits_box(ring, box(1, 1, 2, 1.5)).alias("inside"),
        F.sqrt(g.distance_squared(F.lit(33.0), F.lit(20.0), line)).alias("d"), F.size(g.points_along(line, 10)).alias("p"), g.line_from_json(F.lit("{")).alias("bad"),
    ).first()
    assert (r.n, r.a, r.e, r.i, r.o, r.miss, r.hit, r.inside, r.d, r.p, r.bad) == (90.0, 8.0, 0.5, True, False, False, True, True, 3.0, 9, [])


def test_utm_there_and_back(spark):
    points = spark.createDataFrame([(9.0, 45.0), (-71.3, -33.2), (179.9, 0.5)], "lon double, lat double").withColumn("zone", utm.zone_of(F.col("lon")))
    east, north = utm.to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    placed = points.select("lon", "lat", "zone", east.alias("e"), north.alias("n"))
    lon, lat = utm.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    rows = placed.select("lon", "lat", "e", "n", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert rows[0].e == pytest.approx(500000) and rows[0].n == pytest.approx(4982950.4, abs=0.1)
    assert all(r.lon2 == pytest.approx(r.lon, abs=1e-8) and r.lat2 == pytest.approx(r.lat, abs=1e-8) for r in rows)


def test_catalogue_guards(spark):
    rows = spark.createDataFrame([("a", "x")], "event string, region string")
    assert catalog.first_of(rows, "event", "a", "region") == "x"
    with pytest.raises(LookupError):
        catalog.first_of(rows, "event", "b", "region")
    with pytest.raises(ValueError):
        catalog.select_when(rows, "during")
    assert catalog.select_when(rows, None) is rows


def test_items_without_a_time_are_incomplete(spark):
    items = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02"), ("a", None)], "event string, t string")
    dates = spark.createDataFrame([("a", "2024-01-02")], "event string, d string").select("event", F.to_date("d").alias("event_date"))
    row = catalog.completeness(catalog.split_by_date(items, dates, "t"), ["event"]).first()
    assert (row.n_pre, row.n_post, row.n, row.complete) == (1, 1, 3, False)


def test_match_rate_without_images(spark):
    none = spark.createDataFrame([], "event string, when string, mosaic string, img string")
    assert catalog.match_rate(none).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "dates.csv").write_text("﻿Event;Aligned name;date;month;day;year;date2\nx;a;2020-02-03;2;3;2020;t\ny;;2020-01-01;1;1;2020;t\n;;;;;;\n")
    assert [(r.event, str(r.event_date)) for r in readers.event_dates(spark, str(tmp_path / "dates.csv")).collect()] == [("a", "2020-02-03")]
    (tmp_path / "countries.csv").write_text("region_name,countries\nAfrica,\"['TCD', 'MLI']\"\n")
    assert {r.country for r in readers.region_countries(spark, str(tmp_path / "countries.csv")).collect()} == {"TCD", "MLI"}
    (tmp_path / "roads.tsv").write_text('ITA\t{"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}\nITA\t{"geo\n')
    assert [len(r.geometry) for r in readers.roads(spark, [str(tmp_path / "roads.tsv")]).collect()] == [2, 0]
    (tmp_path / "items.geojson").write_text('{"features": [{"properties": {"quadkey": "012", "proj:bbox": "1, 2,3,4.5", "proj:epsg": 32633, "datetime": "2024"}}]}')
    assert readers.mosaic_items(spark, str(tmp_path / "items.geojson")).select("quadkey", "x0", "y1", "srid").first()[:] == ("012", 1.0, 4.5, 32633)
    place = tmp_path / "in" / "flood" / "pre" / "m1"
    place.mkdir(parents=True)
    (place / "0123.tif").write_bytes(bytes(range(12)))
    assert readers.tiles(spark, str(tmp_path / "in")).select("event", "when", "mosaic", "tile").first()[:] == ("flood", "pre", "m1", "0123")
    (tmp_path / "b.jsonl").write_text('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]},"properties":{"h":"3"}}\n')
    links = spark.createDataFrame([("x", "0123", str(tmp_path / "b.jsonl")), ("x", "9", "/none")], readers.BUILDING_LINKS)
    wanted = spark.createDataFrame([("0123",)], "QuadKey string")
    assert len(readers.footprints(spark, links, wanted).first().geometry) == 3
    assert readers.footprints(spark, links.limit(0), wanted).count() == 0
    patches = spark.createDataFrame([("0123", 0, 1, 1, 2, 2), ("0123", 1, 9, 9, 2, 2)], "tile string, patch_seq int, row int, col int, height int, width int")

    def decode(content, row, col, height, width):
        image = [content[r * 4 + c] for r in range(row, row + height) for c in range(col, col + width) if r * 4 + c < len(content)]
        return image or None

    seen = readers.windows(readers.rasters(spark, str(tmp_path / "in")), patches, decode, "tile string, patch_seq int, top int, left int, image array<int>")
    assert [(r.patch_seq, r.image) for r in seen.collect()] == [(0, [5, 6, 9, 10])]


def test_writers(spark, tmp_path):
    pixels = spark.createDataFrame([("e", "pre", "m", "t", "tree", 1, 2)], "event string, when string, mosaic string, tile string, channel string, row int, col int")
    at = str(tmp_path / "masks")
    writers.masks(pixels, at)
    with pytest.raises(AnalysisException):
        writers.masks(pixels, at)
    writers.masks(pixels, at, overwrite=True)
    assert spark.read.parquet(at).first().file == "e/pre/m/t_tree.tif"
    feature = spark.createDataFrame([("01", [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)], 5)], "QuadKey string, geometry array<struct<x:double,y:double>>, h int")
    writers.geojson_lines(feature, str(tmp_path / "json"))
    assert '"coordinates":[[[0.0,0.0],[1.0,0.0],[0.0,0.0]]]' in spark.read.text(str(tmp_path / "json")).first().value
    writers.csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_model_boundary(spark):
    out = infer.apply_model(spark.createDataFrame([("t", 5)], "tile string, patch_seq int"), infer.stub_detector, infer.DETECTIONS)
    assert out.count() == 2


def test_streams(spark, tmp_path):
    source = tmp_path / "arriving"
    source.mkdir()
    (source / "a.json").write_text('{"path": "r/e/pre/m/1.tif"}\n{"path": "r/e/pre/m/2.tif"}\n')
    done = spark.createDataFrame([("e", "pre", "m", "1")], "event string, when string, mosaic string, tile string")
    for _ in range(2):  # the second run finds nothing new
        stream = arrivals.new_tiles(arrivals.arriving(spark, str(source), "path string"), done)
        arrivals.append_results(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert [r.tile for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["2"]
    events = tmp_path / "events"
    events.mkdir()
    (events / "a.json").write_text('{"t": "2024-01-01T01:00:00", "k": "x"}\n{"t": "2024-01-01T02:00:00", "k": "x"}\n{"t": "2024-01-09T00:00:00", "k": "y"}\n')
    counted = arrivals.counts_by_window(arrivals.arriving(spark, str(events), "t timestamp, k string"), "t", "k")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.table("counted").collect()) == [("x", 2), ("y", 1)]


def test_random_patches_are_drawn_by_many_tasks(spark):
    """All tiles of a small file drew in one task before."""
    tiles = spark.range(50).selectExpr("id", "0D x0", "0D y0", "40D x1", "40D y1").coalesce(1)
    found = tiling.random_patches(tiles, 5, 20, 1, "id")
    assert found.count() == 20
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
