"""More registered queries: footprints, both sides of an event, batches, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import utm
from tessera.functions.boxes import Corners
from tessera.operators import catalog, raster, tiling
from tessera.operators import spatial_join as sj
from tessera.plans import fixtures as fx
from tessera.plans import infer
from tessera.plans.queries import INVERSE, UTM_SQL, K, box, drawn, patch, query, rounded
from tessera.sources import readers, writers

# Footprints and two sides


def footprints(spark: SparkSession, d: str) -> DataFrame:
    """A right triangle for each part, under a quadkey that several have."""
    x, y = "cast(p_partkey % 50 * 100 as double)", "cast(p_partkey % 37 * 100 as double)"
    corners = (("0D", "0D"), ("150D", "0D"), ("0D", "150D"), ("0D", "0D"))
    ring = ", ".join(f"named_struct('x', {x} + {dx}, 'y', {y} + {dy})" for dx, dy in corners)
    return fx.expr(fx.read(spark, d, "part"), "p_partkey", "lpad(p_partkey % 150, 9, '0') quadkey", f"array({ring}) geometry")


FOOTPRINTS = "footprints AS (SELECT p_partkey, lpad((p_partkey % 150)::VARCHAR, 9, '0') AS quadkey, (p_partkey % 50 * 100)::DOUBLE AS x, (p_partkey % 37 * 100)::DOUBLE AS y FROM part)"


@query(f"""WITH {fx.TILES}, {FOOTPRINTS} SELECT img, min(p_partkey) AS p_partkey, arg_min(x, p_partkey) AS x0, arg_min(y, p_partkey) AS y0
 FROM (SELECT DISTINCT img FROM tiles) JOIN footprints ON img = quadkey GROUP BY img""")
def q_tile_footprint(spark, d):
    """Each tile's first footprint."""
    tiles = fx.tiles(spark, d).select("img").distinct()
    found = catalog.first_match(tiles, footprints(spark, d), "img", "quadkey", "p_partkey")
    e = g.envelope(F.col("geometry"))
    return found.select("img", "p_partkey", e.x0.alias("x0"), e.y0.alias("y0"))


@query(f"""WITH {fx.TILES}, {FOOTPRINTS} SELECT DISTINCT img FROM tiles WHERE img NOT IN (SELECT quadkey FROM footprints)""")
def q_tiles_without_footprint(spark, d):
    return fx.tiles(spark, d).select("img").distinct().join(footprints(spark, d), F.col("img") == F.col("quadkey"), "left_anti")


def sides(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps in space and time of an event's pre and post tiles, which are right triangles in
    boxes of 150, with both triangles."""
    placed = fx.tiles(spark, d).selectExpr("event", "when", "cast(event_id % 40 * 100 as double) x", "cast(event_id % 23 * 100 as double) y", "cast(event_id % 30 as double) mint", "cast(event_id % 30 + 12 as double) maxt").distinct()
    side = lambda w, p: placed.where(F.col("when") == w).select(*(F.col(c).alias(f"{p}_{c}") for c in ("event", "x", "y", "mint", "maxt")))
    a, b = (Corners(F.col(f"{p}_x"), F.col(f"{p}_y"), F.col(f"{p}_x") + 150, F.col(f"{p}_y") + 150) for p in "ab")
    met = sj.overlap_join_in_time(side("pre", "a"), side("post", "b"), a, b, ("a_mint", "a_maxt"), ("b_mint", "b_maxt"), cell=200, size=150).where("a_event = b_event")
    ring = lambda p: g.ring([(F.col(f"{p}_x"), F.col(f"{p}_y")), (F.col(f"{p}_x") + 150, F.col(f"{p}_y")), (F.col(f"{p}_x"), F.col(f"{p}_y") + 150)])
    own = met.select(F.col("a_event").alias("event"), *a.common(b).columns(), "mint", "maxt", ring("a").alias("pre"), ring("b").alias("post"), "a_x", "a_y", "b_x", "b_y").distinct()
    return catalog.not_empty(own, "overlaps of tiles before and after an event")


SIDES = """placed AS (SELECT DISTINCT event, "when", (event_id % 40 * 100)::DOUBLE AS x, (event_id % 23 * 100)::DOUBLE AS y, (event_id % 30)::DOUBLE AS mint, (event_id % 30 + 12)::DOUBLE AS maxt FROM tiles),
 sides AS (SELECT DISTINCT a.event, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", greatest(a.mint, b.mint) AS mint, least(a.maxt, b.maxt) AS maxt
  FROM placed a JOIN placed b ON a.event = b.event AND a."when" = 'pre' AND b."when" = 'post' AND abs(a.x - b.x) <= 150 AND abs(a.y - b.y) <= 150 AND a.mint <= b.maxt AND b.mint <= a.maxt)"""


@query(f"""WITH {fx.TILES}, {SIDES} SELECT DISTINCT event, greatest(ax, bx) AS x0, greatest(ay, "by") AS y0, least(ax, bx) + 150 AS x1, least(ay, "by") + 150 AS y1, mint, maxt FROM sides""")
def q_prepost_space_time(spark, d):
    return sides(spark, d).select("event", "x0", "y0", "x1", "y1", "mint", "maxt").distinct()


TWO_SQL = f"""WITH {fx.TILES}, {SIDES}, spots AS (SELECT DISTINCT event, ax, ay, bx, "by", greatest(ax, bx) AS x0, greatest(ay, "by") AS y0, 150 - abs(ax - bx) AS w, 150 - abs(ay - "by") AS h FROM sides),
 grid AS (SELECT *, greatest(1, ceil((w - 40) / 30) + 1)::INT AS cols, unnest(range(greatest(1, ceil((h - 40) / 30) + 1)::INT)) AS i FROM spots),
 patches AS (SELECT *, (i * cols + j)::INT AS patch_seq, x0 + j * 30 AS px0, y0 + i * 30 AS py0 FROM grid, range(10) r(j) WHERE j < cols)
 SELECT DISTINCT event, x0, y0, ax, ay, bx, "by", patch_seq FROM patches
 WHERE px0 <= ax + 150 AND py0 <= ay + 150 AND greatest(px0, ax) - ax + greatest(py0, ay) - ay <= 150 AND px0 <= bx + 150 AND py0 <= "by" + 150 AND greatest(px0, bx) - bx + greatest(py0, "by") - "by" <= 150"""


@query(TWO_SQL)
def q_two_polygon_grid(spark, d):
    """Patches over what both sides have in common that meet both sides' polygons."""
    spots = sides(spark, d).drop("mint", "maxt").distinct()
    met = tiling.grid(spots, 40, 30, "pre").where(g.polygon_hits_box(F.col("post"), patch()))
    return met.select("event", "x0", "y0", F.col("a_x").alias("ax"), F.col("a_y").alias("ay"), F.col("b_x").alias("bx"), F.col("b_y").alias("by"), "patch_seq").distinct()


def tries(axis: str) -> str:
    return drawn(axis, "spot", "k")


@query(f"""WITH {fx.TILES}, {SIDES}, spots AS (SELECT DISTINCT event || ' ' || ax::BIGINT || ' ' || ay::BIGINT || ' ' || bx::BIGINT || ' ' || "by"::BIGINT AS spot, ax, ay, bx, "by", greatest(ax, bx) AS x0, greatest(ay, "by") AS y0, 150 - abs(ax - bx) AS w, 150 - abs(ay - "by") AS h FROM sides),
 shared AS (SELECT *, ceil(w * h / (SELECT sum(w * h) FROM spots) * 60 * 2)::INT + 1 AS n FROM spots), tries AS (SELECT *, unnest(range(1, n + 1)) AS k FROM shared),
 tried AS (SELECT *, x0 + {tries("7x")} * greatest(0.0::DOUBLE, w - 20) AS px0, y0 + {tries("7y")} * greatest(0.0::DOUBLE, h - 20) AS py0, {tries("7o")} AS o FROM tries)
 SELECT spot, px0, py0 FROM tried WHERE px0 + 10 - ax + py0 + 10 - ay < 150 AND px0 + 10 - bx + py0 + 10 - "by" < 150 ORDER BY o, spot, k LIMIT 60""")
def q_two_polygon_random(spark, d):
    """Random patches over what both sides have in common, with their centre in both polygons."""
    spot = F.concat_ws(" ", "event", *(F.col(c).cast("long").cast("string") for c in ("a_x", "a_y", "b_x", "b_y")))
    spots = sides(spark, d).drop("mint", "maxt").distinct().withColumn("spot", spot)
    return tiling.random_patches(spots, 20, 60, 7, "spot", ("pre", "post")).select("spot", "px0", "py0")


@query(f"""WITH {fx.LINES}, {fx.EDGES}, {FOOTPRINTS}, one AS (SELECT DISTINCT ax, ay, bx, "by", o_orderkey FROM edges) SELECT DISTINCT o_orderkey, p_partkey FROM one JOIN footprints
 ON least(ax, bx) <= x + 150 AND greatest(ax, bx) >= x AND least(ay, "by") <= y + 150 AND greatest(ay, "by") >= y AND least(ax + ay, bx + "by") <= x + y + 150 AND greatest(ax + ay, bx + "by") >= x + y
 AND NOT (least((bx - ax) * (y - ay) - ("by" - ay) * (x - ax), (bx - ax) * (y - ay) - ("by" - ay) * (x + 150 - ax), (bx - ax) * (y + 150 - ay) - ("by" - ay) * (x - ax)) > 0)
 AND NOT (greatest((bx - ax) * (y - ay) - ("by" - ay) * (x - ax), (bx - ax) * (y - ay) - ("by" - ay) * (x + 150 - ax), (bx - ax) * (y + 150 - ay) - ("by" - ay) * (x - ax)) < 0)""")
def q_polygon_hits_lines(spark, d):
    """Lines that truly meet a tile's polygon."""
    tiles = footprints(spark, d).select("p_partkey", F.col("geometry").alias("ring"))
    lines = fx.lines(spark, d).select("o_orderkey", "geometry")
    return sj.lines_and_polygons(tiles, lines, "ring", "geometry", ["o_orderkey", "p_partkey"], 150)


# Enumeration and totals


@query(f"""WITH {fx.TILES}, e AS (SELECT DISTINCT event FROM tiles), m AS (SELECT DISTINCT event, "when", mosaic FROM tiles), t AS (SELECT DISTINCT event, "when", mosaic, img FROM tiles)
 SELECT event, "when", mosaic, img, event || '/' || "when" || '/' || mosaic || '/' || img || '.tif' AS path FROM e JOIN m USING (event) JOIN t USING (event, "when", mosaic)""")
def q_event_mosaic_tiles(spark, d):
    tiles = fx.tiles(spark, d)
    return catalog.enumerated(tiles.select("event").distinct(), tiles.select("event", "when", "mosaic").distinct(), tiles.select("event", "when", "mosaic", "img").distinct())


@query(f"""WITH {fx.TILES} SELECT event, row_number() OVER (ORDER BY min(event_id))::INT AS place FROM tiles GROUP BY event""")
def q_events_in_order(spark, d):
    """Distinct events by their first tile."""
    return catalog.in_order(fx.tiles(spark, d), "event", "event_id")


@query(f"""WITH {fx.TILES}, {fx.BOXES}, m AS (SELECT DISTINCT event, mosaic, (length(event) * 300 + right(mosaic, 1)::INT * 900)::DOUBLE AS mx FROM tiles)
 SELECT event, count(*) FILTER (class = 'building') AS n_build, count(*) FILTER (class = 'road') AS n_road FROM m JOIN boxes ON x0 <= mx + 1000 AND mx <= x1 AND y0 <= 1000 AND 0 <= y1 GROUP BY event""")
def q_features_per_event(spark, d):
    """Buildings and roads in the boxes of each event's mosaics; one in two mosaics counts twice."""
    mosaics = fx.tiles(spark, d).select("event", "mosaic").distinct().withColumn("mx", (F.length("event") * 300 + F.right("mosaic", F.lit(1)).cast("int") * 900).cast("double"))
    area = Corners(F.col("mx"), F.lit(0.0), F.col("mx") + 1000, F.lit(1000.0))
    met = sj.overlap_join(mosaics, fx.boxes(spark, d), area, box(), 1000, size_a=1000, size_b=fx.BOX_SIZE)
    return met.groupBy("event").agg(F.count_if(F.col("class") == "building").alias("n_build"), F.count_if(F.col("class") == "road").alias("n_road"))


@query(f"""WITH {fx.DATES} SELECT event, year(event_date)::INT AS year, month(event_date)::INT AS month, day(event_date)::INT AS day, true AS same FROM dates""")
def q_date_parts(spark, d):
    return catalog.date_parts(fx.dates(spark, d), "event_date").select("event", "year", "month", "day", (F.make_date("year", "month", "day") == F.col("event_date")).alias("same"))


@query("SELECT r_name AS region, lower(r_name) || '.tsv' AS file FROM region WHERE r_regionkey % 2 = 0")
def q_region_files(spark, d):
    """Files named after regions; some regions have none."""
    regions = fx.read(spark, d, "region").select(F.col("r_name").alias("region"), "r_regionkey")
    files = regions.where("r_regionkey % 2 = 0").select(F.concat("region", F.lit(".tsv")).alias("name")).unionByName(spark.createDataFrame([("OTHER.tsv",)], "name string"))
    return catalog.files_of(regions.select("region"), files, "region", ".tsv").select("region", F.lower("name").alias("file"))


@query(f"""WITH {fx.BOXES}, m AS (SELECT l_linenumber AS event, class, CASE class WHEN 'building' THEN 34 ELSE 33 END AS zone, min(x0) + 400000 AS x0, min(y0) + 4900000 AS y0, max(x1) + 400000 AS x1, max(y1) + 4900000 AS y1 FROM boxes GROUP BY ALL),
 first AS (SELECT event, arg_min(zone, class) AS toz FROM m GROUP BY event), corners AS (SELECT event, zone, toz, corner, CASE corner WHEN 0 THEN x0 ELSE x1 END AS x, CASE corner WHEN 0 THEN y0 ELSE y1 END AS y FROM m JOIN first USING (event), (SELECT unnest([0, 1]) AS corner)),
 s AS (SELECT *, y / {utm.SCALE * utm.RADIUS!r} AS xi, (x - {utm.EASTING!r}) / {utm.SCALE * utm.RADIUS!r} AS eta FROM corners),
 k AS (SELECT * EXCLUDE (xi, eta), xi {INVERSE[0]} AS p, eta {INVERSE[1]} AS e FROM s), c AS (SELECT *, asin(sin(p) / cosh(e)) AS chi FROM k),
 l AS (SELECT event, zone, toz, corner, x, y, zone * 6 - 183 + degrees(atan2(sinh(e), cos(p))) AS lon, degrees(chi {" ".join(f"+ {x!r} * sin({2 * j} * chi)" for j, x in enumerate(utm.DELTA, 1))}) AS lat FROM c),
 f AS (SELECT *, radians(lat) AS phi, radians(lon - (toz * 6 - 183)) AS lam FROM l), h AS (SELECT *, sinh(atanh(sin(phi)) - {utm.ECCENTRIC!r} * atanh({utm.ECCENTRIC!r} * sin(phi))) AS t FROM f),
 n AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM h),
 u AS (SELECT event, toz, corner, CASE WHEN zone = toz THEN x ELSE {utm.EASTING!r} + {utm.SCALE * utm.RADIUS!r} * (eta + {UTM_SQL[0]}) END AS x, CASE WHEN zone = toz THEN y ELSE {utm.SCALE * utm.RADIUS!r} * (xi + {UTM_SQL[1]}) END AS y FROM n)
 SELECT event, toz AS zone, round(min(x) FILTER (corner = 0), 3) AS x0, round(min(y) FILTER (corner = 0), 3) AS y0, round(max(x) FILTER (corner = 1), 3) AS x1, round(max(y) FILTER (corner = 1), 3) AS y1 FROM u GROUP BY event, toz""")
def q_bbox_across_zones(spark, d):
    """Mosaics of an event in two UTM zones, in one box of the first one's zone."""
    boxes = catalog.bounding_box(fx.boxes(spark, d), ["l_linenumber", "class"])
    moved = boxes.select(F.col("l_linenumber").alias("event"), "class", F.when(F.col("class") == "building", 34).otherwise(33).alias("zone"), *((F.col(c) + (400000 if c[0] == "x" else 4900000)).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return rounded(catalog.bounding_box_across(moved, ["event"], "class"), 3, "x0", "y0", "x1", "y1")


# Batches


@query(f"""WITH {fx.PLOTS}, n AS (SELECT p_partkey, patch_seq, (patch_seq // 4)::INT AS batch_ix, (patch_seq % 4)::INT AS place FROM patches), last AS (SELECT p_partkey, max(patch_seq) AS m FROM n GROUP BY 1)
 SELECT p_partkey, patch_seq, batch_ix, place, false AS is_pad FROM n UNION ALL SELECT p_partkey, -1, (m // 4)::INT, k::INT, true FROM last, range(4) t(k) WHERE k > m % 4""")
def q_padded_batches(spark, d):
    dealt = tiling.batches(fx.plot_patches(spark, d), 4, ["p_partkey"])
    return tiling.padded(dealt, 4, ["p_partkey"]).select("p_partkey", F.coalesce("patch_seq", F.lit(-1)).alias("patch_seq"), "batch_ix", "place", "is_pad")


@query(f"WITH {fx.PLOTS} SELECT p_partkey, patch_seq, (patch_seq // 2)::INT AS batch_ix FROM patches WHERE patch_seq // 2 <= 3")
def q_early_stop(spark, d):
    return tiling.until(tiling.batches(fx.plot_patches(spark, d), 2, ["p_partkey"]), 3).select("p_partkey", "patch_seq", "batch_ix")


@query(f"""WITH {fx.POLYGONS}, p AS (SELECT p_partkey, (i * cols + j)::INT AS patch_seq FROM (SELECT p_partkey, unnest(range(greatest(1, ceil((p_size + 3 - 15) / 10::DOUBLE) + 1)::INT)) AS i, greatest(1, ceil((p_size - 15) / 10::DOUBLE) + 1)::INT AS cols FROM polygons), range(10) r(j) WHERE j < cols),
 n AS (SELECT p_partkey, patch_seq, row_number() OVER (PARTITION BY p_partkey ORDER BY patch_seq) - 1 AS k FROM p)
 SELECT p_partkey, (k // 3)::INT AS batch_ix, count(*) AS n, string_agg(patch_seq::VARCHAR, ',' ORDER BY patch_seq) AS patches FROM n GROUP BY ALL""")
def q_polygon_batches(spark, d):
    """Patches that meet a polygon, in batches, each batch collated to one row."""
    tiles = fx.polygons(spark, d).select("p_partkey", "geometry", *g.envelope(F.col("geometry")).columns())
    dealt = tiling.batches(tiling.grid(tiles, 15, 10, "geometry"), 3, ["p_partkey"])
    one = tiling.collated(dealt, ["p_partkey"], ["patch_seq"])
    return one.select("p_partkey", "batch_ix", "n", F.array_join(F.transform("patch_seq", lambda x: x.cast("string")), ",").alias("patches"))


@query(f"""WITH {fx.BOXES}, {fx.PATCHES}, n AS (SELECT patch_seq, row_number() OVER (PARTITION BY patch_seq ORDER BY x0, y0, x1, y1, {K}) - 1 AS k FROM boxes JOIN patches ON x0 <= px1 AND px0 <= x1 AND y0 <= py1 AND py0 <= y1)
 SELECT patch_seq, (k // 50)::INT AS sub_ix, count(*) AS n_boxes FROM n GROUP BY ALL""")
def q_sub_batches(spark, d):
    """Queries of 50 boxes at most for each patch."""
    met = sj.overlap_join(fx.patches(spark), fx.boxes(spark, d), patch(), box(), fx.SIZE, size_a=fx.SIZE, size_b=fx.BOX_SIZE)
    return tiling.sub_batches(met, 50, ["patch_seq"], ["x0", "y0", "x1", "y1", *fx.KEY]).groupBy("patch_seq", "sub_ix").agg(F.count("*").alias("n_boxes"))


# Geometry, rasters and the model boundary


@query(f"""WITH {fx.LINES}, v AS (SELECT o_orderkey, 0 AS n, x AS vx, y AS vy FROM lines UNION ALL SELECT o_orderkey, 1, x + 40, y + 10 FROM lines UNION ALL SELECT o_orderkey, 2, x + 40, y - 25 FROM lines)
 SELECT o_orderkey, n::INT AS n, (vx - 100) / 0.5 AS col, (900 - vy) / 0.5 AS "row" FROM v""")
def q_line_to_patch(spark, d):
    """Vertices of lines in pixels of a patch."""
    moved = g.in_patch(F.col("geometry"), F.lit(100.0), F.lit(900.0), 0.5)
    return fx.lines(spark, d).select("o_orderkey", F.posexplode(moved).alias("n", "v")).select("o_orderkey", "n", F.col("v.x").alias("col"), F.col("v.y").alias("row"))


@query(f"""WITH {fx.LOGITS} SELECT image, (patch_seq % 15 * 4 + "row")::INT AS "row", (patch_seq // 15 % 15 * 4 + col)::INT AS col, max(v)::DOUBLE AS v
 FROM pixels WHERE patch_seq % 15 * 4 + "row" < 60 AND patch_seq // 15 % 15 * 4 + col < 60 GROUP BY ALL""")
def q_canvas_by_position(spark, d):
    """Patches on a canvas by their row and column in the grid."""
    rows = fx.patch_logits(spark, d).withColumns({"i": (F.col("patch_seq") % 15).cast("int"), "j": F.expr("cast(patch_seq div 15 % 15 as int)")})
    own = raster.pixels_of(rows, "embedding", 8, ["patch_seq", "image", "i", "j"])
    return raster.blend(raster.on_canvas_at(own, "i", "j", 4, 60, 60), ["image", "row", "col"], "max").withColumn("v", F.col("v").cast("double"))


@query(f"""WITH {fx.LOGITS} SELECT image, "row", col, bool_or(v >= 0 AND channel = 'road') AS road, bool_or(v >= 0 AND channel = 'tree') AS tree, bool_or(v >= 0 AND channel = 'building') AS building FROM pixels GROUP BY image, "row", col""")
def q_channel_stack(spark, d):
    """A column for each channel but the one that pads."""
    own = raster.pixels_of(fx.patch_logits(spark, d), "embedding", 8, ["image", "channel"])
    return raster.stacked(raster.fold_any(own, ["image", "channel", "row", "col"]), ["image", "row", "col"])


@query("""WITH s AS (SELECT p_partkey, p_size * 40 + 100 AS w, p_partkey % 17 * 60 + 200 AS h FROM part), t AS (SELECT *, least(800, round(1333 * least(w, h) / greatest(w, h)::DOUBLE))::INT AS side FROM s)
 SELECT p_partkey, CASE WHEN w <= h THEN side ELSE floor(side * w / h::DOUBLE) END::INT AS width, CASE WHEN w <= h THEN floor(side * h / w::DOUBLE) ELSE side END::INT AS height,
 round((w % 256 / 255::DOUBLE - 0.485) / 0.229, 9) AS red FROM t""")
def q_model_input(spark, d):
    """The size that an image is brought to, and a normalised value."""
    w, h = F.col("p_size") * 40 + 100, F.col("p_partkey") % 17 * 60 + 200
    width, height = infer.resized(w, h)
    return fx.read(spark, d, "part").select("p_partkey", width.alias("width"), height.alias("height"), F.round(infer.normalised(w % 256, 0), 9).alias("red"))


@query(f"""WITH {fx.BOXES}, {fx.PATCHES} SELECT patch_seq, {K}, patch_seq * 0.5::DOUBLE + (x1 - x0) AS v FROM boxes JOIN patches ON x0 <= px1 AND px0 <= x1 AND y0 <= py1 AND py0 <= y1 WHERE class = 'tree'""")
def q_embed_decode(spark, d):
    """A patch is embedded once for all of its boxes, by stand-ins for the models."""
    met = sj.overlap_join(fx.patches(spark), fx.boxes(spark, d).where("class = 'tree'"), patch(), box(), fx.SIZE, size_a=fx.SIZE, size_b=fx.BOX_SIZE)
    keys = ["patch_seq", *fx.KEY]
    return infer.embed_once(met.select(*keys, "x0", "x1"), ["patch_seq"], infer.stub_embedder, f"patch_seq int, {', '.join(f'{k} {t}' for k, t in met.select(*fx.KEY).dtypes)}, v double")


# Files written and read back, below the shared folder


@query(f"WITH {fx.TILES} SELECT event, count(*) AS n_images, round(sum(area), 4) AS area FROM tiles GROUP BY event")
def q_csv_round_trip(spark, d):
    stats = fx.tiles(spark, d).groupBy("event").agg(F.count("*").alias("n_images"), F.round(F.sum("area"), 4).alias("area"))
    at = writers.folder(spark, "stats")
    writers.csv(stats, at)
    return readers.csv(spark, at, "event string, n_images long, area double")


@query(f"WITH {fx.DATES} SELECT event, event_date::VARCHAR AS day FROM dates")
def q_event_dates_file(spark, d):
    """Semicolons and a byte order mark; rows without an aligned name are left out."""
    day = F.col("event_date")
    line = F.concat_ws(";", F.concat(F.lit("x"), "event"), "event", day.cast("string"), F.month(day), F.dayofmonth(day), F.year(day), day.cast("string"))
    named = fx.dates(spark, d).select(line.alias("value"))
    head = spark.createDataFrame([("\ufeffEvent;Aligned name;date;month;day;year;date2\nnobody;;2024-01-01;1;1;2024;2024-01-01",)], "value string")
    at = writers.folder(spark, "dates")
    head.unionByName(named).coalesce(1).sortWithinPartitions(~F.col("value").contains("Aligned")).write.text(at)
    return readers.event_dates(spark, at).select("event", F.col("event_date").cast("string").alias("day"))


@query(f"""WITH {fx.LINES} SELECT o_orderkey % 5 AS country, count(*) AS n, sum(x) AS sx, sum(y) AS sy FROM lines GROUP BY 1""")
def q_roads_file(spark, d):
    """Tab-separated lines without a header, written and read."""
    points = F.transform("geometry", lambda v: F.array(v["x"], v["y"]))
    feature = F.to_json(F.struct(F.struct(F.lit("LineString").alias("type"), points.alias("coordinates")).alias("geometry")))
    at = writers.folder(spark, "roads")
    fx.lines(spark, d).select(F.concat_ws("\t", (F.col("o_orderkey") % 5).cast("string"), feature).alias("value")).write.text(at)
    start = F.get("geometry", F.lit(0))
    roads = readers.roads(spark, [at]).select(F.col("country").cast("long").alias("country"), start["x"].alias("x"), start["y"].alias("y"))
    return roads.groupBy("country").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query(f"""WITH {FOOTPRINTS} SELECT p_partkey, x AS x0, y AS y0, 4::INT AS n_vertices FROM footprints WHERE quadkey IN ('000000003', '000000077')""")
def q_footprints_file(spark, d):
    """Features written by quadkey; two keys' files are read by their links."""
    at = writers.folder(spark, "footprints")
    writers.geojson_lines(footprints(spark, d).withColumnRenamed("quadkey", "QuadKey"), at)
    links = footprints(spark, d).select(F.lit("here").alias("Location"), F.col("quadkey").alias("QuadKey"), F.concat(F.lit(f"{at}/QuadKey="), "quadkey").alias("Url")).distinct()
    wanted = spark.createDataFrame([("000000003",), ("000000077",)], "QuadKey string")
    found = readers.footprints(spark, links, wanted)
    e = g.envelope(F.col("geometry"))
    return found.select(F.col("properties.p_partkey").cast("long").alias("p_partkey"), e.x0.alias("x0"), e.y0.alias("y0"), F.size("geometry").alias("n_vertices"))


@query("""SELECT lpad(p_partkey::VARCHAR, 9, '0') AS quadkey, (p_partkey % 50)::DOUBLE AS x0, (p_partkey % 37)::DOUBLE AS y0, (p_partkey % 50 + p_size)::DOUBLE AS x1, (p_partkey % 37 + 1)::DOUBLE AS y1, 32633::INT AS srid FROM part""")
def q_mosaic_items_file(spark, d):
    """Items of collections, one collection a file."""
    text = F.concat_ws(",", *((c).cast("string") for c in (F.col("p_partkey") % 50, F.col("p_partkey") % 37, F.col("p_partkey") % 50 + F.col("p_size"), F.col("p_partkey") % 37 + 1)))
    item = F.struct(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("quadkey"), text.alias("proj:bbox"), F.lit(32633).alias("proj:epsg"))
    features = fx.read(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("_f")).agg(F.collect_list(F.struct(item.alias("properties"))).alias("features"))  # a collection is a document
    at = writers.folder(spark, "items")
    features.select("_f", F.to_json(F.struct("features")).alias("value")).write.partitionBy("_f").text(at)
    return readers.mosaic_items(spark, at).select("quadkey", "x0", "y0", "x1", "y1", "srid")


@query(f"""WITH {fx.TILES} SELECT event, "when", mosaic, count(DISTINCT img) AS n FROM tiles GROUP BY ALL""")
def q_masks_file(spark, d):
    """Set pixels written by event, side and mosaic, and read back by those columns."""
    own = fx.tiles(spark, d).select("event", "when", "mosaic", F.col("img").alias("tile")).distinct().withColumns({"channel": F.lit("road"), "row": F.lit(1), "col": F.lit(2)})
    at = writers.folder(spark, "masks")
    writers.masks(own, at)
    back = spark.read.parquet(at)
    return back.groupBy("event", "when", "mosaic").agg(F.count_distinct("file").alias("n"))


@query("SELECT r_name AS event, 'pre' AS \"when\", 'm' || r_regionkey AS mosaic, 't' || r_regionkey AS tile FROM region")
def q_listing(spark, d):
    """Files below a folder and the columns of their paths."""
    at = writers.folder(spark, "tree")
    rows = fx.read(spark, d, "region").selectExpr("r_name event", "'pre' `when`", "concat('m', r_regionkey) mosaic", "concat('t', r_regionkey) tile")
    fx.marks(rows.select(F.concat_ws("/", "event", "when", "mosaic", F.concat("tile", F.lit(".tif"))).alias("path")), at)
    return readers.tiles(spark, at).drop("path")
